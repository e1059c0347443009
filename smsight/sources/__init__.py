"""Reading and writing messaging data."""
