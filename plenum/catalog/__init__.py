"""Runnable queries over the shared tables, each beside the SQL that checks it.

A catalog module maps a query name to a pair: a function of (spark, folder) and an equivalent
SQL text over the same tables, or ``None`` where SQL cannot say it.
"""
