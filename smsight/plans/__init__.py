"""Registered queries, the tables they read and their SQL counterparts."""
