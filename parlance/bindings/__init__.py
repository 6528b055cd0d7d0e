"""Queries over the driver's tables, with the SQL each is checked against."""
