"""Reading and writing episode tables."""
