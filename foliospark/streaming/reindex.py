"""Keeping the index current from a stream of sections: an extension beyond batch indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.functions.porter import stems
from foliospark.operators.index import StoredIndex, fingerprints, stale


def reindex(spark: SparkSession, source: DataFrame, index_path: str, checkpoint: str, stem=stems) -> StreamingQuery:
    """Start a query that re-indexes the documents of each micro-batch whose fingerprint is new.

    `source` streams whole documents as rows (doc_id, sec_idx, id, title, text). A batch adds one segment with its changed
    documents, whatever the size of the index; a batch that is run again finds them current, or writes the segment that
    was left unfinished anew. Compact the index from time to time.
    """
    index = StoredIndex(spark, index_path, stem)

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        now = fingerprints(rows)
        changed = rows
        if index.segments():
            new = stale(now, index.registry()).select(F.col("doc_id").alias("d_"))
            changed = rows.join(new, F.expr("doc_id = d_"), "left_semi")
        if not changed.isEmpty():
            index.add(changed)
        rows.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
