"""Readers and sinks."""

from .csv import read_csv, validate_csv_filename
from .reports import list_sections, purge_runs, purged_runs, read_section, write_experiment, write_sections
from .tables import read_parquet, read_table

__all__ = [
    "list_sections", "purge_runs", "purged_runs", "read_csv", "read_parquet", "read_section", "read_table", "validate_csv_filename",
    "write_experiment", "write_sections",
]
