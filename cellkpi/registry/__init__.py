"""The checked queries: Spark jobs over the test tables, and the same results in SQL."""
