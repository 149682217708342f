"""The frame operators on plain tables: a column is the data, other columns name the frame and the order."""

from millrace.operators.tables import (  # noqa: F401
    attach, chop, combine, count_across, dedup, each, extreme, generate, group_by, joined, keep, ngrams, pick, running, split, top, transpose,
)
