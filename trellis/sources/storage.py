"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/trellis-shared"
    return base.rstrip("/")


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trellis-{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local(df: DataFrame, most: int) -> tuple[DataFrame, pa.Table] | None:
    """Up to ``most`` rows as a local table, whose size the planner knows, so
    that it joins by broadcast; None if there are more."""
    table = df.limit(most + 1).toArrow()
    if table.num_rows > most:
        return None
    return df.sparkSession.createDataFrame(table, df.schema), table


class Levels:
    """Keeps the levels of an iteration so that plans don't grow with its rounds.

    A level of up to ``small`` rows becomes a local table, which joins by
    broadcast in one stage; a larger one, and all after it, are written to the
    shared folder.  What reaches the driver is bounded by ``small``.  A level
    is cached while it is tried, so that a large one is computed once."""

    def __init__(self, kind: str, small: int = 5_000) -> None:
        self.kind, self.small = kind, small

    def keep(self, df: DataFrame) -> tuple[DataFrame, int]:
        if not self.small:
            out = written(df, self.kind)
            return out, out.count()
        df = df.persist()
        try:
            if (found := local(df, self.small)) is not None:
                return found[0], found[1].num_rows
            self.small = 0
            out = written(df, self.kind)
            return out, out.count()
        finally:
            df.unpersist()
