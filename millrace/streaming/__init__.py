"""The operators that make sense on streams: single-chunk units as they are, dedup and counts under watermarks, running folds with state."""

from millrace.streaming.operators import dedup, each, group_windows, running_state, to_table

__all__ = ["dedup", "each", "group_windows", "running_state", "to_table"]
