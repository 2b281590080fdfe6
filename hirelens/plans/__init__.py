"""The queries that the driver calls, each with its form in SQL."""
