"""Column expressions: cell names, calendar buckets, numbers and dates."""
