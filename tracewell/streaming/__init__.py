"""New extracts as a stream: each micro-batch of edges is merged into the stored table, existing edges win."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tracewell.operators.catalog import first_wins
from tracewell.operators.merge import EDGE_KEY
from tracewell.schemas import TABLE_DEP

_STORED = StructType([*TABLE_DEP, StructField("batch", LongType())])


def follow_edges(spark: SparkSession, incoming: str, stored: str, checkpoint: str) -> StreamingQuery:
    """Read Parquet edges that arrive in a folder and append those that the stored table lacks; runs what is there and stops."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        fresh = first_wins(batch.where("source_id IS NOT NULL AND target_id IS NOT NULL"), EDGE_KEY, "seq").select(*TABLE_DEP.names)
        folder = f"{stored}/batch={batch_id}"  # a repeated batch replaces its own folder, so replays add nothing twice
        older = s.read.schema(_STORED).parquet(stored).where(f"batch < {batch_id}") if batch_id or _exists(s, stored) else None
        if older is not None:
            fresh = fresh.join(older.select(*EDGE_KEY), EDGE_KEY, "left_anti").select(*TABLE_DEP.names)
        fresh.write.mode("overwrite").parquet(folder)

    stream = spark.readStream.schema(TABLE_DEP).parquet(incoming)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)
