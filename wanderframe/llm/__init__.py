"""Operators for large text corpora: order, dedup, quality, tokens, chat, privacy, scoring.

Nothing else in the library imports this subpackage.  Its queries and oracle SQL are in
``wanderframe.llm.queries``.
"""
