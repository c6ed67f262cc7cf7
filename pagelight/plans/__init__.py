"""Reports and the queries that are registered."""
