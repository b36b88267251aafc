"""Operators for preparing language-model training text at scale.

Nothing outside this package imports it.  ``registry`` lists its queries and
their SQL; the top-level ``corpus_pipeline`` chains five of its operators.
"""
