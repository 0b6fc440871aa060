"""Queries of the library by name, with the SQL of the same rows."""
