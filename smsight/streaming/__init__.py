"""Structured Streaming versions of the feedback, click, bandit and counting jobs."""
