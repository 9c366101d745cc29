"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`loamstone.llm.queries` derives the registered
``opN_`` queries from them.
"""
