"""Corpus-preparation operators for training data, one module per operator.

Nothing outside this subpackage imports it; ``queries.py`` holds the digest
queries and ``oracles.py`` the SQL that checks them.
"""
