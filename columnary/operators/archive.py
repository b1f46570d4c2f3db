"""Run archive as tables: list, search, statistics, experiments, purge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPERIMENT_TYPE = "array<struct<id:string,type:string,created_at:string,summary:string>>"


def list_runs(runs: DataFrame, owner: int | None = None) -> DataFrame:
    """Saved runs, newest first, with experiment count and the latest experiment.

    ``runs`` comes from ``with_experiments``, or holds ``experiments``, newest first.
    """
    mine = runs if owner is None else runs.where(F.col("user_id") == owner)
    if "experiment_count" in runs.columns:
        return mine.orderBy(F.desc("id"))
    count = F.coalesce(F.size("experiments"), F.lit(0))
    return mine.select(
        "*", F.greatest(count, F.lit(0)).alias("experiment_count"), F.try_element_at("experiments", F.lit(1)).alias("latest_experiment")
    ).orderBy(F.desc("id"))


def search_runs(listing: DataFrame, query: str = "", readiness: str = "all", ml: str = "all") -> DataFrame:
    """Filter a listing by text, readiness (all, ml-ready, eda-first) and
    experiments (all, with-ml, without-ml)."""
    out = listing
    if readiness not in ("all", "ml-ready", "eda-first") or ml not in ("all", "with-ml", "without-ml"):
        raise ValueError("unknown filter")
    ready = F.coalesce(F.col("insights.is_ready"), F.lit(False))
    if readiness != "all":
        out = out.where(ready if readiness == "ml-ready" else ~ready)
    if ml != "all":
        out = out.where(F.col("experiment_count") > 0 if ml == "with-ml" else F.col("experiment_count") == 0)
    wanted = query.strip().lower()
    if wanted:
        words = [F.col("overview.dataset_name"), F.col("source_filename"), F.col("insights.summary"), F.col("status"), F.col("latest_experiment.summary")]
        haystack = F.concat_ws(" ", *[F.nullif(w, F.lit("")) for w in words])
        out = out.where(F.contains(F.lower(haystack), F.lit(wanted)))
    return out


def archive_statistics(listing: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """One row: runs, filtered view, runs with experiments, ready runs, latest."""
    stats = listing.agg(
        F.count(F.lit(1)).alias("saved_runs"),
        F.count_if(F.col("experiment_count") > 0).alias("runs_with_ml"),
        F.count_if(F.coalesce(F.col("insights.is_ready"), F.lit(False))).alias("ready_runs"),
        F.coalesce(F.sum("experiment_count"), F.lit(0)).cast("long").alias("total_experiments"),
        F.max_by(F.col("overview.dataset_name"), F.col("id")).alias("latest_dataset"),
    )
    view = (listing if filtered is None else filtered).agg(F.count(F.lit(1)).alias("filtered_runs"))
    return stats.crossJoin(view)  # one row each


def live_experiments(experiments: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Experiments without the deleted ones (a table of ``analysis_id, experiment_id``)."""
    if deleted is None:
        return experiments
    return experiments.join(deleted.select("analysis_id", "experiment_id").distinct(), ["analysis_id", "experiment_id"], "left_anti")


def latest_results(experiments: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Newest surviving experiment per run and type."""
    live = live_experiments(experiments, deleted)
    order = F.struct("created_at", "experiment_id")
    newest = F.max_by(F.struct("experiment_id", "created_at", "summary"), order).alias("newest")
    return live.groupBy("analysis_id", "experiment_type").agg(newest, F.count(F.lit(1)).alias("experiment_count")).select(
        "analysis_id", "experiment_type", "newest.*", "experiment_count"
    )


def with_experiments(runs: DataFrame, experiments: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Runs with the number of their experiments and the newest one, by combinable aggregates."""
    live = live_experiments(experiments, deleted)
    entry = F.struct(F.col("experiment_id").alias("id"), F.col("experiment_type").alias("type"), "created_at", "summary")
    newest = live.groupBy(F.col("analysis_id").alias("id")).agg(
        F.count(F.lit(1)).cast("int").alias("experiment_count"), F.max_by(entry, F.struct("created_at", "experiment_id")).alias("latest_experiment"))
    return runs.join(newest, "id", "left").withColumn("experiment_count", F.coalesce("experiment_count", F.lit(0)))


def attach_experiments(runs: DataFrame, experiments: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Runs with their experiments as an array, newest first."""
    live = live_experiments(experiments, deleted)
    entry = F.struct(F.col("created_at").alias("at"), F.col("experiment_id").alias("id"), F.col("experiment_type").alias("type"), F.col("summary"))
    newest_first = F.sort_array(F.collect_list(entry), asc=False)
    packed = live.groupBy(F.col("analysis_id").alias("id")).agg(
        F.transform(newest_first, lambda e: F.struct(e["id"].alias("id"), e["type"].alias("type"), e["at"].alias("created_at"), e["summary"].alias("summary"))).alias("experiments")
    )
    return runs.join(packed, "id", "left").withColumn("experiments", F.coalesce("experiments", F.array().cast(EXPERIMENT_TYPE)))


def append_experiment(experiments: DataFrame, analysis_id: int, experiment_type: str, experiment_id: str, created_at: str, summary: str) -> DataFrame:
    row = [(analysis_id, experiment_id, experiment_type, created_at, summary)]
    fresh = experiments.sparkSession.createDataFrame(row, "analysis_id long, experiment_id string, experiment_type string, created_at string, summary string")
    return experiments.unionByName(fresh)


def purge_runs(runs: DataFrame, owner: int, analysis_id: int | None = None) -> DataFrame:
    """What remains after deleting one run, or all runs, of an owner."""
    gone = F.col("user_id") == owner
    if analysis_id is not None:
        gone = gone & (F.col("id") == analysis_id)
    return runs.where(~F.coalesce(gone, F.lit(False)))


def purge_experiments(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """Experiments whose run still exists."""
    return experiments.join(runs.select(F.col("id").alias("analysis_id")), "analysis_id", "left_semi")
