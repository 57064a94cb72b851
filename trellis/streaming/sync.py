"""Change-log replay: normalisation, batch application and streaming.

A log row has id, table, op (I, U, D or T), old_key, new_key, old_row and
new_row (JSON of the row's columns).  Rows up to a high-water mark are folded
to the last state of each key, so applying any number of changes is one
anti-join and one union for each changed table.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.catalog import Source, key_text
from trellis.errors import GraphError

LOG_SCHEMA = "id long, table string, op string, old_key string, new_key string, old_row string, new_row string"
OPS = ("I", "U", "D", "T")


def pending(log: DataFrame, applied: int, upto: int | None = None) -> DataFrame:
    out = log.where(F.col("id") > applied)
    return out if upto is None else out.where(F.col("id") <= upto)


def folded(changes: DataFrame) -> DataFrame:
    """(table, key, row): the last state of each changed key, row null where it
    is gone.  An update that moves a key removes the old and writes the new; a
    truncation removes all keys before it, given as key null."""
    moved = F.coalesce(F.col("old_key"), F.lit("")) != F.coalesce(F.col("new_key"), F.lit(""))
    gone = changes.where((F.col("op") == "D") | ((F.col("op") == "U") & moved)).select("id", "table", F.col("old_key").alias("key"), F.lit(None).cast("string").alias("row"), F.lit(0).alias("part"))
    here = changes.where(F.col("op").isin("I", "U")).select("id", "table", F.col("new_key").alias("key"), F.col("new_row").alias("row"), F.lit(1).alias("part"))
    cut = changes.where(F.col("op") == "T").groupBy("table").agg(F.max("id").alias("cut"))
    live = gone.unionByName(here).join(F.broadcast(cut), "table", "left").where(F.col("cut").isNull() | (F.col("id") > F.col("cut")))  # a row for each table at most
    last = live.groupBy("table", "key").agg(F.max_by("row", F.struct("id", "part")).alias("row"))
    return last.unionByName(cut.select("table", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("row")))


def normalised(changes: DataFrame) -> DataFrame:
    """Edge or node deltas of a batch by key: exactly one insertion and one
    deletion cancel; else a deletion wins, then the latest id."""
    g = changes.groupBy("table", "key").agg(
        F.count_if(F.col("op") == "I").alias("ins"), F.count_if(F.col("op") == "D").alias("dels"), F.max("id").alias("id"),
        F.max_by("op", "id").alias("last"),
    )
    kept = g.where(~((F.col("ins") == 1) & (F.col("dels") == 1)))
    return kept.select("table", "key", F.when(F.col("dels") > 0, "D").otherwise(F.col("last")).alias("op"), "id")


def apply_table(source: Source, key_columns: tuple[str, ...], states: DataFrame) -> Source:
    """The source after its folded changes (key, row)."""
    schema = source.df.schema
    cleared = not states.where("key is null").isEmpty()
    base = source.df.where("false") if cleared else source.df.withColumn("_key", key_text(key_columns)).join(states.select(F.col("key").alias("_key")), "_key", "left_anti").drop("_key")
    rows = states.where("row is not null").select(F.from_json("row", schema).alias("r")).select(*(F.col(f"r.{f.name}").cast(f.dataType).alias(f.name) for f in schema.fields))
    return replace(source, df=base.unionByName(rows.select(*source.df.columns)))


def counts(changes: DataFrame) -> tuple[int, int, int]:
    r = changes.agg(*(F.count_if(F.col("op") == op).alias(op) for op in OPS)).head()
    return r.I, r.U, r.D + r["T"]


def check(changes: DataFrame, known: set[str]) -> None:
    bad = changes.where(~F.col("op").isin(*OPS) | ~F.col("table").isin(sorted(known))).limit(1).collect()
    if bad:
        raise GraphError("execution", f"log row {bad[0].id} has an unknown table or operation")


def stream(spark, path: str, apply, checkpoint: str):
    """Follows a folder of log files: each micro-batch goes to ``apply`` as a
    batch, so a restart replays from the last committed one."""
    rows = spark.readStream.schema(LOG_SCHEMA).parquet(path)
    return rows.writeStream.foreachBatch(lambda batch, _: apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each key, whole."""
    w = Window.partitionBy("table", F.coalesce("new_key", "old_key")).orderBy(F.desc("id"))
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
