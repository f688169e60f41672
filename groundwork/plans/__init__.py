"""Registered queries over the given tables, each with its ANSI SQL twin."""
