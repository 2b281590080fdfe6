"""DataFrame operators of the screening engine."""
