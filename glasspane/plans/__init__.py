"""Registered queries, each a composition of operators, with their SQL."""
