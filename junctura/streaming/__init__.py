"""Record chunks as they arrive."""
