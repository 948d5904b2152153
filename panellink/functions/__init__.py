"""Fixed values, normal forms, ids, roles and similarity functions."""
