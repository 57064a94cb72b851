"""Connected components of the stored edges, taken without direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.sources.storage import Levels


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with ``name``, their place in this order, from 0.

    A range shuffle sorts them; the numbers of rows of its partitions, all that
    reaches the driver, give each partition its first place."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    local = local.withColumn("_part", F.shiftright("_place", 33).cast("int")).persist()
    before, total = {}, 0
    for part, n in sorted((r["_part"], r.n) for r in local.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        before[part], total = total, total + n
    first = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("_part")] if before else F.lit(0)
    return local.withColumn(name, (F.col("_place") - F.shiftleft(F.col("_part").cast("bigint"), 33) + first).cast("bigint")).drop("_place", "_part")


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with ``nid``, their place by table and id, from 0."""
    return placed(nodes, ["ord", "id"], "nid").select("label", "ord", "id", "nid")


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v): each node of an edge with the least node of its component, by
    alternating large-star and small-star rounds until all edges are stars."""
    levels = Levels("components")
    now, n = levels.keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while n:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now, n = levels.keep(pairs.select("e.u", "e.v").where("u != v").distinct())
        state = (n, now.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()[0])
        if state == before:
            break
        before = state
    return now


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_table, node_id, ord, component_id, component_size); the id is the
    least place of the component's nodes."""
    named = numbered(nodes)
    keys = named.select(F.col("label"), F.col("id"), "nid")
    links = (
        edges.where("not reversed")
        .join(keys.select(F.col("label").alias("src_label"), F.col("id").alias("src_id"), F.col("nid").alias("u")), ["src_label", "src_id"])
        .join(keys.select(F.col("label").alias("dst_label"), F.col("id").alias("dst_id"), F.col("nid").alias("v")), ["dst_label", "dst_id"])
        .select("u", "v")
    )
    stars = contracted(links).select(F.col("u").alias("nid"), "v")
    labelled = named.join(stars, "nid", "left").select("label", "ord", "id", F.coalesce("v", "nid").alias("component_id"))
    sizes = labelled.groupBy("component_id").agg(F.count("*").alias("component_size"))
    return labelled.join(sizes, "component_id").select(F.col("label").alias("node_table"), F.col("id").alias("node_id"), "ord", "component_id", F.col("component_size").cast("int").alias("component_size"))
