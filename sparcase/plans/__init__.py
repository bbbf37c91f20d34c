"""Queries: each operator applied to the tables, with equivalent SQL where SQL can say it."""
