"""Keeping the index up to date from a stream of file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.embed import Embedder
from ..operators.ingest import Decoders, ingest
from ..operators.store import Store
from ..settings import Settings
from ..sources.vault import changes


def watch(spark: SparkSession, root: str, store: Store, embedder: Embedder, checkpoint: str, decoders: Decoders | None = None, once: bool = False, settings: Settings | None = None) -> StreamingQuery:
    """Starts a query that reindexes what was created or modified and drops what was deleted, batch by batch.

    A batch that is replayed after a failure indexes the same files again, which changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        changed = batch.where("event_type <> 'deleted'").select("path").distinct()
        gone = batch.where("event_type = 'deleted'").select(F.col("path").alias("file_path")).distinct()
        if not changed.isEmpty():
            ingest(batch.sparkSession, root, store, embedder, paths=changed, decoders=decoders, settings=settings)
        if not gone.isEmpty():
            store.apply(store.index().where(F.lit(False)), store.state().where(F.lit(False)), gone)

    writer = changes(spark, root, f"{checkpoint}/listings").writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint}/query")
    return (writer.trigger(availableNow=True) if once else writer).start()
