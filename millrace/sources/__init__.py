"""Where chunks come from and where they go: files by patterns, literals, tables; files by templates of names, tables."""

from millrace.sources.files import dump, emit, listing, read_blocks, read_files, read_lines, write_table
from millrace.sources.tables import read_csv, read_database, read_json_lines

__all__ = ["dump", "emit", "listing", "read_blocks", "read_csv", "read_database", "read_files", "read_json_lines", "read_lines", "write_table"]
