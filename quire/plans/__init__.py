"""Plans that chain operators: query building and search."""
