"""Reading and writing tables."""

from ledgerline.sources.tables import catalog_of, count_records, estimate_rows, list_tables, read_ddl_log, read_table, read_tsv, recent_ddl, write_jdbc, write_table, write_tsv

__all__ = ["catalog_of", "count_records", "estimate_rows", "list_tables", "read_ddl_log", "read_table", "read_tsv", "recent_ddl", "write_jdbc", "write_table", "write_tsv"]
