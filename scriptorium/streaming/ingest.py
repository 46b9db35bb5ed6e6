"""Documents that arrive as files are appended to an index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..sources.files import DOCUMENT


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(index: Index, documents: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream of documents. A batch that is run again after a failure adds nothing twice, since ids that are there
    are skipped; documents without an id, title or abstract are skipped as well."""

    def append(batch: DataFrame, _: int) -> None:
        good = batch.where(F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("abstract").isNotNull())
        if not good.isEmpty():
            index.add(good)

    writer = documents.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
