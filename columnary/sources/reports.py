"""Report sink: one table per section, partitioned by run.

Every run keeps its own schema. A purge first leaves a written mark for each run,
which hides it from every read, and then removes its folders: a purge that stops
half way shows nothing of these runs and is completed by calling it again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "json")
_SCHEMAS, _MARKS = "_schemas", "_purged"


def write_sections(sections: dict[str, DataFrame], path: str, analysis_id: int, fmt: str = "parquet") -> None:
    """Write every section of a report; writing a run again replaces it.

    Only the folder of this run is overwritten, so a retried write is safe and
    an empty section replaces a full one. The schema is kept beside the rows.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    spark = next(iter(sections.values())).sparkSession if sections else None
    if spark is not None and analysis_id in purged_runs(spark, path):
        purge_runs(spark, path, [analysis_id])  # what an earlier purge left of this run
        _remove(spark, f"{path}/{_MARKS}/analysis_id={analysis_id}")
    for name, table in sections.items():
        table.write.mode("overwrite").format(fmt).save(f"{path}/{name}/analysis_id={analysis_id}")
        note = table.sparkSession.createDataFrame([(table.schema.json(),)], "schema string")
        note.write.mode("overwrite").json(f"{path}/{_SCHEMAS}/{name}/analysis_id={analysis_id}")


def read_section(spark: SparkSession, path: str, name: str, analysis_id: int | None = None, fmt: str = "parquet") -> DataFrame:
    """One section, of one run (partition pruned) or of all with the columns of all their schemas."""
    notes = spark.read.schema("schema string, analysis_id long").json(f"{path}/{_SCHEMAS}/{name}")
    gone = purged_runs(spark, path)
    wanted = notes if analysis_id is None else notes.where(F.col("analysis_id") == analysis_id)
    kept = wanted.where(~F.col("analysis_id").isin(gone)) if gone else wanted
    kinds = [r["schema"] for r in kept.groupBy("schema").agg(F.max("analysis_id").alias("last")).orderBy(F.desc("last")).collect()]
    if not kinds:  # the run does not exist or is purged
        other = notes.first()
        if other is None:
            raise ValueError(f"no run of section {name} is stored")
        return _stored(spark, path, name, fmt, other["schema"]).where(F.lit(False))
    found = None
    for kind in kinds:  # one read for each different schema
        table = _stored(spark, path, name, fmt, kind)
        runs = kept.where(F.col("schema") == kind).select("analysis_id")
        part = table.where(F.col("analysis_id") == analysis_id) if analysis_id is not None else table.join(F.broadcast(runs), "analysis_id", "left_semi").select(table.columns)
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


def _stored(spark: SparkSession, path: str, name: str, fmt: str, schema: str) -> DataFrame:
    return spark.read.format(fmt).schema(T.StructType.fromJson(json.loads(schema)).add("analysis_id", "long")).load(f"{path}/{name}")


def purge_runs(spark: SparkSession, path: str, analysis_ids: list[int]) -> None:
    """Remove all sections of the given runs; safe to repeat."""
    for run in analysis_ids:
        spark.range(1).write.mode("overwrite").json(f"{path}/{_MARKS}/analysis_id={run}")
    for name in list_sections(spark, path):
        for run in analysis_ids:
            _remove(spark, f"{path}/{name}/analysis_id={run}")
            _remove(spark, f"{path}/{_SCHEMAS}/{name}/analysis_id={run}")


def purged_runs(spark: SparkSession, path: str) -> list[int]:
    """Runs with a mark of a purge."""
    files, folder = _files(spark, f"{path}/{_MARKS}")
    if not files.exists(folder):
        return []
    return sorted(int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(folder) if "=" in s.getPath().getName())


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _remove(spark: SparkSession, path: str) -> None:
    files, folder = _files(spark, path)
    files.delete(folder, True)


def write_experiment(result: DataFrame, path: str, analysis_id: int, experiment_id: str, fmt: str = "parquet") -> None:
    out = result.withColumn("analysis_id", F.lit(analysis_id).cast("long")).withColumn("experiment_id", F.lit(experiment_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id", "experiment_id").format(fmt).save(path)


def list_sections(spark: SparkSession, path: str) -> list[str]:
    """Names of the stored sections."""
    files, folder = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory() and not s.getPath().getName().startswith("_"))
