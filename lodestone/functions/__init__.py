"""Column functions: paths, globs, predicates and scalars."""
