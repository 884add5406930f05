"""Column-level building blocks: parsing, normalising and scoring single rows."""
