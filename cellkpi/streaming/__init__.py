"""Loading extracts as they arrive."""
