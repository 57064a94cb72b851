"""Snapshots of a built graph: Parquet generations, delta segments and a manifest.

Files are read and written through Spark and Hadoop's file system alone, so a
folder may be in any store that Spark reads.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.errors import GraphError
from trellis.operators.build import EDGE_SCHEMA, NODE_SCHEMA, Graph

VERSION = 1


@dataclass
class Manifest:
    generation: int = 0
    watermark: int = 0
    base: str = ""
    segments: list[dict] = field(default_factory=list)
    has_unidirectional: bool = False
    weighted: bool = False
    version: int = VERSION
    times: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.folder}/{name}"))

    def size(self, name: str) -> int:
        p = self.path(f"{self.folder}/{name}")
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else 0

    def names(self) -> list[str]:
        p = self.path(self.folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def delete(self, name: str) -> int:
        n = self.size(name)
        self.fs.delete(self.path(f"{self.folder}/{name}"), True)
        return n

    def manifests(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.names() if n.startswith("manifest-") and n.endswith(".json"))

    def load(self, generation: int | None = None) -> Manifest | None:
        found = self.manifests()
        if not found:
            return None
        n = found[-1] if generation is None else generation
        stream = self.fs.open(self.path(f"{self.folder}/manifest-{n:09d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            m = Manifest(**json.loads(text))
        except (ValueError, TypeError):
            raise GraphError("corrupt_file", f"manifest {n} can't be read") from None
        if m.version != VERSION:
            raise GraphError("incompatible_version", f"snapshot version {m.version}")
        return m

    def publish(self, m: Manifest, what: str) -> Manifest:
        """Writes the next generation's manifest; a reader sees it whole or not at all."""
        m.generation = (self.manifests() or [0])[-1] + 1
        m.times[what] = time.time_ns() // 1000
        draft, final = (self.path(f"{self.folder}/{n}") for n in (f".draft-{m.generation}", f"manifest-{m.generation:09d}.json"))
        self.fs.mkdirs(self.path(self.folder))
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(asdict(m)).encode()))
        finally:
            out.close()
        if not self.fs.rename(draft, final):
            raise GraphError("build_locked", f"generation {m.generation} was published by another session")
        return m

    def save(self, graph: Graph, watermark: int) -> Manifest:
        base = f"base-{time.time_ns()}"
        graph.nodes.write.parquet(f"{self.folder}/{base}/nodes")
        graph.edges.repartition("src_label", "src_id").sortWithinPartitions("src_label", "src_id").write.parquet(f"{self.folder}/{base}/edges")
        return self.publish(Manifest(0, watermark, base, [], graph.has_unidirectional, graph.weighted), "build")

    def add_segment(self, m: Manifest, nodes: DataFrame, edges: DataFrame, rows: int, watermark: int, level: int = 0) -> Manifest:
        """Deltas: rows with ``op`` I or D beside the columns of nodes and edges."""
        name = f"segment-{time.time_ns()}"
        nodes.write.parquet(f"{self.folder}/{name}/nodes")
        edges.write.parquet(f"{self.folder}/{name}/edges")
        m.segments = [*m.segments, {"name": name, "level": level, "rows": rows}]
        m.watermark = max(m.watermark, watermark)
        return self.publish(m, "ingest")

    def read(self, m: Manifest | None = None) -> Graph:
        """Base without what segments delete, with what they add."""
        m = m or self.load()
        if m is None:
            raise GraphError("not_built", "there is no snapshot")
        try:
            nodes = self.spark.read.schema(NODE_SCHEMA).parquet(f"{self.folder}/{m.base}/nodes")
            edges = self.spark.read.schema(EDGE_SCHEMA).parquet(f"{self.folder}/{m.base}/edges")
        except Exception as e:
            raise GraphError("corrupt_file", f"generation {m.generation} can't be read") from e
        for s in m.segments:
            dn = self.spark.read.schema(f"op string, {NODE_SCHEMA}").parquet(f"{self.folder}/{s['name']}/nodes")
            de = self.spark.read.schema(f"op string, {EDGE_SCHEMA}").parquet(f"{self.folder}/{s['name']}/edges")
            nodes = nodes.join(dn.select("label", "id").distinct(), ["label", "id"], "left_anti").unionByName(dn.where("op = 'I'").drop("op"))
            key = ["mapping_id", "source_key"]
            edges = edges.join(de.select(*key).distinct(), key, "left_anti").unionByName(de.where("op = 'I'").drop("op"))
        return Graph(nodes, edges, m.has_unidirectional, m.weighted)

    def compact(self, m: Manifest) -> Manifest:
        g = self.read(m)
        base = f"base-{time.time_ns()}"
        g.nodes.write.parquet(f"{self.folder}/{base}/nodes")
        g.edges.repartition("src_label", "src_id").write.parquet(f"{self.folder}/{base}/edges")
        return self.publish(Manifest(0, m.watermark, base, [], m.has_unidirectional, m.weighted, VERSION, m.times), "compact")

    def collect_garbage(self, retain: int, active: set[int]) -> dict:
        """Deletes manifests beyond the newest ``retain`` that no session holds, and files none refers to."""
        found = self.manifests()
        keep = set(found[-retain:]) | (active & set(found))
        used = set()
        for n in keep:
            m = self.load(n)
            used |= {m.base, *(s["name"] for s in m.segments)}
        old = [f"manifest-{n:09d}.json" for n in found if n not in keep] + [n for n in self.names() if n.startswith(("base-", "segment-")) and n not in used]
        freed = sum(self.delete(n) for n in old)
        return {"valid_generations_scanned": len(found), "retained_generations": sorted(keep), "active_generations": sorted(active), "obsolete_candidates": len(old), "protected_candidates": len(active & set(found[:-retain])), "deleted_files": len(old), "deleted_bytes": freed}

    def validate(self, m: Manifest | None) -> str | None:
        """Why a generation is not readable, or None."""
        if m is None:
            return "no manifest"
        for name in (m.base, *(s["name"] for s in m.segments)):
            if not self.exists(f"{name}/nodes") or not self.exists(f"{name}/edges"):
                return f"{name} is missing"
        try:
            self.read(m).edges.agg(F.count("*")).collect()
        except Exception:
            return "its files can't be read"
        return None
