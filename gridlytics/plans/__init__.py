"""Registered queries: every operator over the given tables, with the SQL it must agree with."""
