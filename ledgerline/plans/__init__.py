"""Plans over whole tables: validation modes, reports and load ledgers."""

from ledgerline.plans.report import ledger_summary, load_progress, load_rates, overall_status, pending, record, report_stats, run_tables
from ledgerline.plans.validate import MODES, choose_strategy, validate

__all__ = ["MODES", "choose_strategy", "ledger_summary", "load_progress", "load_rates", "overall_status", "pending", "record", "report_stats", "run_tables", "validate"]
