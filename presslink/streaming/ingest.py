"""Incremental Word-corpus ingest: new ``*.docx`` files in a directory become articles.

The batch rules are reused unchanged through ``foreachBatch``: an article never
spans two files, so each micro-batch of whole files is processed exactly like
the batch job and appended to the article table. The stream checkpoint records
which files were done, and each micro-batch overwrites its own ``batch_id=``
partition, so a restarted job or a re-run batch neither skips nor repeats a
file's articles. Files that cannot be parsed are listed (``path, error``) per batch
in a second table beside the articles, see :func:`error_path`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from presslink.operators.articles import assemble_articles
from presslink.session import arrow_batch, ensure_checkpoint_dir, materialize

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
from presslink.sources.docx import FILES_PER_BATCH, PARAGRAPH_SCHEMA, _parse_files, corpus_paragraphs


def error_path(output_path: str) -> str:
    """Folder of the table that lists failed files."""
    return f"{output_path.rstrip('/')}_errors"


def stream_docx_articles(spark: SparkSession, input_dir: str, output_path: str,
                         checkpoint_location: str | None = None, available_now: bool = True,
                         max_files_per_trigger: int = 1000) -> StreamingQuery:
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", "*.docx")
             .option("maxFilesPerTrigger", max_files_per_trigger).load(input_dir))
    # Stable across processes (Python's hash() is salted per run), so a restart finds its state.
    key = hashlib.sha1(output_path.encode("utf-8")).hexdigest()[:20]
    ckpt = checkpoint_location or f"{ensure_checkpoint_dir(spark).rstrip('/')}/presslink-stream/{key}"

    def process(batch: DataFrame, batch_id: int) -> None:
        # foreachBatch may re-run a batch after a failure: each batch overwrites its
        # own partition, so a retry replaces rather than duplicates its articles.
        with arrow_batch(batch.sparkSession, FILES_PER_BATCH):
            corpus = materialize(batch.select("path", "content").mapInArrow(_parse_files, PARAGRAPH_SCHEMA))
        (assemble_articles(corpus_paragraphs(corpus), block=None)
         .write.mode("overwrite").parquet(f"{output_path.rstrip('/')}/batch_id={batch_id}"))
        (corpus.filter(F.col("error").isNotNull()).select("path", "error")
         .write.mode("overwrite").parquet(f"{error_path(output_path)}/batch_id={batch_id}"))

    writer = files.writeStream.foreachBatch(process).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
