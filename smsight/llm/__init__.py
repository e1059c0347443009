"""Operators for cleaning, joining, scoring and mixing large text collections."""
