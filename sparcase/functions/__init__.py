"""Column functions: normalising, validating, extracting and comparing texts."""
