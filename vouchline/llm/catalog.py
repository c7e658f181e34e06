"""All registered queries of this folder."""

from vouchline.llm.registry import QUERIES, SQL

from vouchline.llm import decontaminate, language, lines, mixing, neardup, phrases, pii, quality, spelling, substrings, tokens, toxicity, urls  # noqa: F401

__all__ = ["QUERIES", "SQL"]
