"""Queries composed of the operators, each with the SQL that gives the same rows."""
