"""Spark jobs for very large file inventories spread over many repositories."""
