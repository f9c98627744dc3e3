"""Table copy, reconciliation and change-apply as Spark DataFrame operators."""

from ledgerline.session import session

__all__ = ["session"]
