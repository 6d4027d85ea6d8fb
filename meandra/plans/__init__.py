"""Queries over the operators, each with the SQL that it is held against."""
