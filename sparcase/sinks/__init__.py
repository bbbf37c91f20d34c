"""Writing exports, reports and journals."""
