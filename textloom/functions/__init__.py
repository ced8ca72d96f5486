"""Column functions: each takes columns and returns one, null where the reference reports failure."""
