"""Queries of the problems tagged llm, collected from the modules beside this one."""

from __future__ import annotations

from threadloom.llm import q_conversations, q_formatdup, q_leakage, q_pairs, q_pii, q_secrets, q_spam, q_tokenize

_MODULES = (q_conversations, q_pii, q_formatdup, q_secrets, q_pairs, q_tokenize, q_leakage, q_spam)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
