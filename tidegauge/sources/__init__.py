"""Table readers, projections of the given tables, and scratch storage."""
