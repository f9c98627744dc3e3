"""Column functions: canonical texts, hashes, small formats."""

from ledgerline.functions.canonical import (
    byte_diff,
    bytea_to_binary,
    canonical,
    canonical_light,
    export_text,
    format_duration,
    norm_decimal,
    norm_json_ws,
    norm_newlines,
    norm_timestamp,
    norm_uuid,
    pg_array_to_json,
    rtrim_text,
    truncate_values,
    tsv_escape,
    tsv_unescape,
)
from ledgerline.functions.hashing import hash_bucket, hashable_columns, row_hash, row_key

__all__ = [
    "byte_diff",
    "bytea_to_binary",
    "canonical",
    "canonical_light",
    "export_text",
    "format_duration",
    "hash_bucket",
    "hashable_columns",
    "norm_decimal",
    "norm_json_ws",
    "norm_newlines",
    "norm_timestamp",
    "norm_uuid",
    "pg_array_to_json",
    "row_hash",
    "row_key",
    "rtrim_text",
    "truncate_values",
    "tsv_escape",
    "tsv_unescape",
]
