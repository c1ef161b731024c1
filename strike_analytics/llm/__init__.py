"""Operators for preparing training data: one module for each.

Every module offers its operator (``DataFrame -> DataFrame``, general
parameters, real outputs) and the ``opN_*`` query that applies it to a table
with production parameters. ``registry`` gathers the queries and their SQL.
"""
