"""Registered queries: views over the test tables, the queries and their SQL."""
