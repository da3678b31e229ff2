"""Registered queries. registry holds the names; the other modules fill it."""
