"""The index and the file state as versioned Parquet: a version is written beside the live one, then made the live one."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog

INDEX = (
    "file_path string, chunk_id string, chunk_index bigint, text string, heading string, frontmatter_tags string, node_type string, "
    "node_id string, page_number bigint, total_pages bigint, segment_start_s double, segment_end_s double, embedding array<float>, file_type string"
)
STATE = "file_path string, mtime double, indexed_at double"
#: Parts of a table.
BUCKETS = 64


def part_of(path: str) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class Store:
    """Tables ``index`` and ``state`` under a folder of any file system that Spark reads, in BUCKETS parts by a hash of the file's path.

    ``v=N`` holds the parts that version N has written, ``live=N`` tells of each part the version it is of. A commit writes
    only the parts that it touches, so a change to few files costs little however large the index is.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The complete versions, ascending."""
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [p.getPath().getName() for p in self.fs.listStatus(self.path(self.root))]
        return sorted(int(n[5:]) for n in names if n.startswith("live="))

    def version(self) -> int:
        """The live version: the newest that is complete."""
        return max(self.versions(), default=0)

    def parts(self, version: int) -> dict[str, dict[str, int]]:
        """For each table the version of each part of it that has rows."""
        if not version:
            return {"index": {}, "state": {}}
        return json.loads(self.spark.read.text(f"{self.root}/live={version}").first()["value"])

    def at(self, table: str, version: int, part: str) -> str:
        return f"{self.root}/v={version}/{table}/_part={part}"

    def read(self, table: str, schema: str) -> DataFrame:
        places = [self.at(table, v, part) for part, v in self.parts(self.version())[table].items()]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def index(self) -> DataFrame:
        return self.read("index", INDEX)

    def state(self) -> DataFrame:
        return self.read("state", STATE)

    def commit(self, index: DataFrame, state: DataFrame, touched: list[int] | None = None, keep: int = 2) -> int:
        """Writes the rows of the ``touched`` parts (all unless given) and makes them live by one file; a crash before that changes nothing.

        Vectors must have one width, that of the live index if any part of it stays. Versions before the last ``keep`` go.
        """
        live = self.version()
        v = max([live, *self.written()], default=0) + 1
        parts = self.parts(live) if touched is not None else {"index": {}, "state": {}}
        gone = set(map(str, touched or ()))
        for table, rows, schema in (("index", index, INDEX), ("state", state, STATE)):
            names = [x.strip().split(" ")[0] for x in schema.split(",")]
            rows.select(*names, part_of("file_path").alias("_part")).repartition("_part").write.partitionBy("_part").parquet(f"{self.root}/v={v}/{table}")
            parts[table] = {p: n for p, n in parts[table].items() if p not in gone}
            written = [x.getPath().getName() for x in self.fs.listStatus(self.path(f"{self.root}/v={v}/{table}"))]
            parts[table] |= {n.removeprefix("_part="): v for n in written if n.startswith("_part=")}
        self.check(v, parts["index"])
        out = self.fs.create(self.path(f"{self.root}/live={v}"))
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        kept = self.versions()[-keep:]
        used = {n for x in kept for table in self.parts(x).values() for n in table.values()} | {v}
        for old in [x for x in self.versions() if x not in kept]:
            self.fs.delete(self.path(f"{self.root}/live={old}"), True)
        for old in [x for x in self.written() if x not in used and x < v]:
            self.fs.delete(self.path(f"{self.root}/v={old}"), True)
        return v

    def written(self) -> list[int]:
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [p.getPath().getName() for p in self.fs.listStatus(self.path(self.root))]
        return [int(n[2:]) for n in names if n.startswith("v=")]

    def check(self, version: int, parts: dict[str, int]) -> None:
        """The vectors that ``version`` has written must be as wide as each other and as one of another part."""
        wide = F.size("embedding")
        places = [self.at("index", n, p) for p, n in parts.items() if n == version]
        if not places:
            return
        new = self.spark.read.schema(INDEX).parquet(*places).where("embedding is not null").agg(F.min(wide), F.max(wide)).first()
        found = {x for x in new if x is not None}
        for p, n in parts.items():
            if n != version:
                old = self.spark.read.schema(INDEX).parquet(self.at("index", n, p)).where("embedding is not null").select(wide).first()
                if old:
                    found.add(old[0])
                    break
        if len(found) > 1:
            raise ValueError(f"vectors of {sorted(found)} numbers in one index")

    def apply(self, new: DataFrame, done: DataFrame, gone: DataFrame | None = None) -> int:
        """Replaces the chunks of the files in ``done`` by those in ``new``; the files in ``gone`` (file_path) leave."""
        stale = done.select("file_path")
        stale = stale.unionByName(gone.select("file_path")) if gone is not None else stale
        touched = sorted(r[0] for r in stale.select(part_of("file_path")).distinct().collect())  # BUCKETS rows at most
        if not touched and self.version():
            return self.version()
        index, state = (x.where(part_of("file_path").isin(touched)) for x in (self.index(), self.state()))
        state = state if gone is None else catalog.without(state, gone)
        return self.commit(catalog.without(index, stale).unionByName(new), catalog.mark(state, done), touched)

    def rebuild(self, new: DataFrame, done: DataFrame, failed: int, total: int, most_failed: float = 0.5) -> int:
        """A version of ``new`` alone, unless too large a share of the files failed: then the live one stays."""
        if total and failed / total > most_failed:
            raise RuntimeError(f"{failed} of {total} files failed; the index stays as it is")
        return self.commit(new, done)


def as_index(chunks: DataFrame) -> DataFrame:
    from ..functions import text as X

    names = [x.strip().split(" ")[0] for x in INDEX.split(",")]
    chunks = chunks.withColumn("chunk_id", X.chunk_id(F.col("file_path"), F.col("chunk_index")))
    return chunks.select(*names)
