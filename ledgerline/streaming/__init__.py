"""Change events, in batch and as streams."""

from ledgerline.streaming.changes import apply_changes, decode_changes, reject_structural, split_key_changes, split_known_tables
from ledgerline.streaming.feed import VersionedTable, liveness, read_changes, start, stream_metrics

__all__ = ["VersionedTable", "apply_changes", "decode_changes", "liveness", "read_changes", "reject_structural", "split_key_changes", "split_known_tables", "start", "stream_metrics"]
