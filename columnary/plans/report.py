"""The complete report of a dataset: every section as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import charts, drift, insights, profile, quality, samples, stats, targets
from ..operators.dataset import Dataset


def ml_capabilities(ds: Dataset) -> DataFrame:
    return insights.capability_gates(ds)


def full_report(ds: Dataset, probe: bool = True) -> dict[str, DataFrame]:
    """All sections. They share the tally, the moments, the quartiles and the
    pair correlations, each computed once for the dataset."""
    return {
        "overview": profile.overview(ds),
        "preview": samples.preview_rows(ds),
        "column_profile": profile.column_profile(ds),
        "unsupported_columns": ds.unsupported_columns(),
        "quality_missing": quality.missing_by_column(ds),
        "quality_flags": quality.quality_flags(ds),
        "quality_correlations": quality.high_correlations(ds),
        "quality_score": quality.quality_score(ds),
        "quality_recommendations": quality.recommendations(ds),
        "numeric_summary": stats.numeric_summary(ds),
        "categorical_summary": stats.categorical_summary(ds),
        "datetime_summary": stats.datetime_summary(ds),
        "correlation_matrix": stats.correlation_matrix(ds),
        "missingness": charts.missingness(ds),
        "histograms": charts.histograms(ds),
        "boxplots": charts.boxplots(ds),
        "top_categories": charts.top_categories(ds),
        "correlation_heatmap": charts.correlation_heatmap(ds),
        "pairwise_scatter": charts.pairwise_scatter(ds),
        "drift_checks": drift.drift_checks(ds),
        "insights": insights.insights(ds),
        "capabilities": ml_capabilities(ds),
        "target_recommendations": targets.target_recommendations(ds, probe=probe),
    }
