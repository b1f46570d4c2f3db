"""Understand a table before modelling it: profiles, quality, statistics, drift,
target advice, model benchmarks and anomaly scans as Spark DataFrames."""

from .operators.dataset import Dataset
from .plans import full_report
from .session import build_session
from .sources import read_csv, read_parquet, read_table

__all__ = ["Dataset", "build_session", "full_report", "read_csv", "read_parquet", "read_table"]
