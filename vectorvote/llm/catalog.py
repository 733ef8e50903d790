"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, decontaminate, hilbert_knn, html_text, lang_id, line_dedup, near_dedup, ngram_lm, pii, token_file

_MODULES = (bpe, decontaminate, hilbert_knn, html_text, lang_id, line_dedup, near_dedup, ngram_lm, pii, token_file)


def queries() -> dict[str, Callable]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE", {}).items()}
