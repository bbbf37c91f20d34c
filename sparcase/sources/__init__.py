"""Reading cases and files."""
