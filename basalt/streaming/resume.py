"""Reference generation as a stream: items that arrive as files are answered once, and appended.

The stream's own checkpoint remembers which files were read; the anti-join with what is already in the
table makes a batch that is run again harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from basalt.functions.text import is_bad_summary
from basalt.plans.providers import Provider, ask
from basalt.sources.sinks import append_missing


def answer_stream(spark: SparkSession, items: str, schema: str, table: str, checkpoint: str, provider: Provider, key: str = "key", prompt: str = "prompt", files_per_batch: int = 1) -> StreamingQuery:
    """Answer (key, prompt) items from Parquet files below `items` as they come, and end when none is left."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(items)

    def batch(rows: DataFrame, _: int) -> None:
        once = rows.dropDuplicates([key])
        append_missing(once, table, key, lambda todo: ask(todo.select(key, prompt), prompt, provider).drop(prompt).withColumn("poor", is_bad_summary("reply")))

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
