"""Fixtures, the registered queries over them, and the SQL each is checked against."""
