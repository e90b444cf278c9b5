"""Queries over the test tables, each with SQL for the same rows where SQL can express it."""
