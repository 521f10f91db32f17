"""Operators for preparing language-model training corpora.

Nothing outside this package imports it. Each operator lives in its own module
with a general interface; :mod:`textloom.llm.queries` applies them, with
production parameters, to the whole intended table.
"""
