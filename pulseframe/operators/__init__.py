"""DataFrame operators: lazy plans built from joins, aggregates and windows."""
