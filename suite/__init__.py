"""Registered queries with the SQL each one is compared with."""
