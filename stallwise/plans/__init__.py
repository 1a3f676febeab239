"""Registered queries and the SQL that they are checked against."""
