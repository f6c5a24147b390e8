"""Streams: watching a folder of changes, keeping tables and sessions current, indexing what arrives.

Tables that a stream keeps are change sets (changesets.py): batch N reads what was there before N and writes the keys that it changes,
so a batch that runs again, in the same process or after a restart, gives what it gave before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import changes, index
from tidemill.storage import work_folder
from tidemill.streaming.changesets import ChangeSets


def folder_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 2) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None] | None = None, path: str | None = None, state: str | None = None) -> None:
    """Run until all that is there has been read. With the same state folder a second run only takes what is new."""
    spark = stream.sparkSession
    w = stream.writeStream.option("checkpointLocation", state or work_folder(spark, "stream")).trigger(availableNow=True)
    (w.foreachBatch(each) if each else w.format("parquet").option("path", path)).start().awaitTermination()


def watch(stream: DataFrame, keep: Column, current: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Changes that the filter keeps; with `current` each comes with the row of its key as it is now."""
    out = stream.where(keep)
    return out if current is None else out.join(current, key, "left")


def once(stream: DataFrame, ids: list[str], ts: str, late: str) -> DataFrame:
    """The stream without events that repeat one with the same ids and time, if they come no later than `late` after it.

    State is kept for the span of the watermark alone.
    """
    time = stream.schema[ts].dataType.simpleString()
    marked = stream if time == "timestamp" else stream.withColumn(ts, F.col(ts).cast("timestamp"))
    out = marked.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)
    return out if time == "timestamp" else out.withColumn(ts, F.col(ts).cast(time))


def deltas(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, op, before, after): rows of the new state that are not in the old one, or other than there, and rows that went."""
    cols = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*cols).alias("before")).join(new.select(key, F.struct(*cols).alias("after")), key, "full")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, op.alias("op"), "before", "after")


def apply_feed(stream: DataFrame, start: DataFrame, key: str, path: str | None = None, state: str | None = None) -> DataFrame:
    """start with all changes (key, seq, op, columns) of the stream applied, batch by batch; the table is in path.

    Order is by seq within a batch; the sequence of the last change of a key is kept beside it (deleted keys
    too), and changes with an older one are dropped, so late and repeated ones do no harm. With the same path and
    state a later run goes on where this one ended, and start is then not looked at.
    """
    spark = stream.sparkSession
    cols = [c for c in start.columns if c != key]
    seen = start.withColumn("_seq", F.lit(-1).cast("long")).withColumn("_gone", F.lit(False))
    table = ChangeSets(spark, path or work_folder(spark, "table"), seen.schema, key)
    table.start(seen)

    def each(batch: DataFrame, number: int) -> None:
        now = table.now(number, table.touched(batch, number)).join(batch.select(key).distinct(), key, "left_semi")
        fresh = batch.join(now.select(key, "_seq"), key, "left").where(F.col("seq") > F.coalesce("_seq", F.lit(-2))).drop("_seq")
        after = changes.apply_changes(now.where("not _gone").select(key, *cols), fresh, key)
        newest = fresh.groupBy(key).agg(F.max("seq").cast("long").alias("_seq"))
        table.put(newest.join(after.withColumn("_here", F.lit(True)), key, "left").select(key, *cols, "_seq", F.col("_here").isNull().alias("_gone")), number)

    drain(stream, each, state=state)
    return table.now().where("not _gone").select(key, *cols)


def session_state(stream: DataFrame, key: str, ts: str, keep: list[str], path: str | None = None, state: str | None = None) -> DataFrame:
    """The last image of each session and when it was last used, over all that the stream brought; kept in path."""
    spark = stream.sparkSession
    image = F.struct(ts, *keep)
    table = ChangeSets(spark, path or work_folder(spark, "sessions"), stream.select(key, image.alias("_image")).schema, key)

    def each(batch: DataFrame, number: int) -> None:
        new = batch.select(key, image.alias("_image")).groupBy(key).agg(F.max("_image").alias("_image"))
        now = table.now(number, table.touched(batch, number)).join(new.select(key), key, "left_semi")
        table.put(now.unionByName(new).groupBy(key).agg(F.max("_image").alias("_image")), number)

    drain(stream, each, state=state)
    return table.now().select(key, F.col("_image")[ts].alias("last_used"), *[F.col("_image")[c].alias(c) for c in keep])


def index_feed(stream: DataFrame, path: str, state: str | None = None, first: int = 0) -> DataFrame:
    """Chunk and embed documents as they come; returns the points, which path keeps.

    Batches are numbered from first, which a new stream into the same table sets beyond those that the table has.
    A document that comes again takes the place of the earlier one with all its points, also those of chunks that it no longer
    has; of one that comes twice in a batch the longest text counts (ties: the last in order). A text without words leaves none.
    """
    spark = stream.sparkSession
    empty = index.points(index.embed(index.windows(spark.createDataFrame([], "doc_id long, text string")), index.hash_embedder()))
    table = ChangeSets(spark, path, empty.schema, "doc_id")

    def each(batch: DataFrame, number: int) -> None:
        docs = batch.groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
        made = index.points(index.embed(index.windows(docs), index.hash_embedder()))
        table.put(made, first + number, docs.where(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))))

    drain(stream, each, state=state)
    return table.now()
