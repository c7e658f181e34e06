"""Bank-statement analytics on Spark: statements in, enriched ledger transactions and reports out."""

from vouchline.session import build_session

__all__ = ["build_session"]
