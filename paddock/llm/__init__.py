"""Operators for building training corpora: filtering, de-duplication, mixing, extraction and tokenising.

Nothing outside this subpackage imports it.  Each module holds one operator; ``queries`` binds them to tables.
"""
