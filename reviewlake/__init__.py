"""Spark jobs for code-review data: sources, operators, scoring and summaries over many repositories."""
