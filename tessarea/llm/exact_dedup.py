"""Exact deduplication as a stateful stream.

The table is read as a stream of files. State is keyed by the digest of the
normalised text, lies on disk (RocksDB, checkpointed to the shared folder) and
never expires; it retains per digest the smallest identifier, the content
locator of that row (file and row number) and the number of rows. Rows are
combined per task before they reach the state, so a digest that a third of all
rows share costs one state update per task.

A hit, that is a row whose digest is known from another row, is then compared in
full with the content that the locator points at. Digests under which texts
differ are grouped anew by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, cut_lineage, prepare, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: no disk set aside for their logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
# Input of one micro-batch.
BATCH_BYTES = 256 << 30


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _located(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``doc_id, file, row, body, digest`` of a file scan, batch or stream."""
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        normalised(F.col("text")).alias("body"),
    ).withColumn("digest", digest(F.col("body")))


def _order() -> Column:
    """Identifier and locator in the order of preference; null identifiers last."""
    return F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "file", "row")


def _as_glob(path: str) -> str:
    """The same path as a pattern: a stream takes a single file only by a pattern."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/{{{name}}}"


def run_state(
    spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES,
    files_per_batch: int | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """Stream the files at ``path`` into the state; ``digest, first, n`` of all digests.

    With a ``checkpoint`` folder of its own a later call takes in new files only.
    """
    checkpoint = checkpoint or scratch_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        reader = spark.readStream.schema(spark.read.parquet(path).schema)
        reader = (
            reader.option("maxFilesPerTrigger", files_per_batch)
            if files_per_batch
            else reader.option("maxBytesPerTrigger", batch_bytes)
        )
        state = (
            _located(reader.parquet(_as_glob(path)), digest)
            .groupBy("digest")
            .agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n"))
        )
        run = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    held = spark.read.format("statestore").option("path", checkpoint).load()
    columns = held.schema["value"].dataType.names
    return held.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.`{columns[0]}`").alias("first"),
        F.col(f"value.`{columns[1]}`").alias("n"),
    )


def dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, **state) -> DataFrame:
    """One row per row of the Parquet table ``path(doc_id, text)``.

    ``doc_id, file, row`` (its locator), ``keep_id`` (identifier of the row that
    stays), ``group_size, kept, text_sha256``. Texts are equal if they are after
    white space is normalised; null counts as empty. Of equal texts the smallest
    ``doc_id`` stays, of equal ids the first locator; a null id only where the
    group has no other. An empty table gives no rows; other columns are not read.
    """
    prepare(spark)
    known = cut_lineage(run_state(spark, path, digest, **state), "dedup-known")
    rows = _located(spark.read.parquet(path), digest)
    # Bodies go on only where there is something to compare.
    base = cut_lineage(
        rows.join(known, "digest").withColumns(
            {
                "text_sha256": F.sha2(F.col("body").cast("binary"), 256),
                "kept": (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row")),
                "body": F.when(F.col("n") > 1, F.col("body")),
            }
        ),
        "dedup-rows",
    )
    hits = base.where("n > 1")
    keepers = hits.where("kept").select("digest", F.col("body").alias("kept_body"))
    clashes = cut_lineage(
        hits.where("NOT kept").join(keepers, "digest").where("body <> kept_body").select("digest").distinct(),
        "dedup-clashes",
    )
    clean = base.join(clashes, "digest", "left_anti")
    mixed = base.join(clashes, "digest", "left_semi")
    groups = cut_lineage(
        mixed.groupBy("body").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n")), "dedup-regrouped"
    )
    mixed = (
        mixed.drop("first", "n")
        .join(groups, "body")
        .withColumn("kept", (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row")))
    )
    return clean.unionByName(mixed).select(
        "doc_id", "file", "row", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), "kept", "text_sha256"
    )


def keep_first(docs: DataFrame, **state) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns.

    The rows are first stored in the shared folder, where the stream finds them.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "dedup-input")
    docs.write.parquet(path)
    found = dedup(spark, path, **state)
    gone = cut_lineage(
        found.where("NOT kept").select(F.col("file").alias("__file"), F.col("row").alias("__row")), "dedup-gone"
    )
    stored = spark.read.schema(docs.schema).parquet(path)
    at = stored.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return at.join(gone, ["__file", "__row"], "left_anti").drop("__file", "__row")
