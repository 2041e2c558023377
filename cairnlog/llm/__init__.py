"""Operators for large training-data corpora. Nothing outside this subpackage imports it."""

from __future__ import annotations

from . import bpe, conversations, embedding, lines, minhash, mixing, packing, spelling, spotsigs, suffix, toxicity, urls, warc

MODULES = (minhash, spotsigs, embedding, suffix, bpe, warc, lines, mixing, packing, toxicity, spelling, conversations, urls)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
