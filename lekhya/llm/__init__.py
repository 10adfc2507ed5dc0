"""Operators for large training-text collections (one module per problem)."""
