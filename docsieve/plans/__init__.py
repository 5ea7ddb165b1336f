"""Queries over the operators, and the report plan that composes them."""
