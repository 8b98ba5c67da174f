"""The census end to end, its report, and the query list."""
