"""Evidence rows in files that are only added to; a text that is stored already is not added again.

    root/rows/commit=<n>-<id>/bucket=<b>/...    rows, dealt by the hash of their content
    root/side/commit=<n>-<id>/...               per bucket: a bitmap of its hashes, 16 bits a row

The side rows tell which files may hold a hash (about one wrong guess in sixteen), so an append reads those
files only. The side folder is renamed into place last: rows without one do not exist.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.operators.numbering import number_rows
from contactmill.session import cut_lineage
from contactmill.sources.deltas import exists, files_at
from contactmill.sources.tables import RAW_SOURCES, struct_of

BUCKETS = 32
# Bits of one bitmap of Spark's bitmap functions, and bits per row.
BLOCK_BITS, BITS_PER_ROW = 32_768, 16
SIDE = "bucket int, rows long, blocks long, top long, block long, bits binary, commit string"
ROWS = f"{RAW_SOURCES}, content_hash string, commit string, bucket int"


def evidence_hash() -> Column:
    """What makes two raw sources the same intake: kind, address and text."""
    parts = [F.coalesce(c, F.lit("")) for c in ("source_type", "source_url", "raw_text")]
    return F.sha2(F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]), 256)


def _bucket(content_hash: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(content_hash), F.lit(buckets)).cast("int")


def _bit(content_hash: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), content_hash), blocks * BLOCK_BITS)


def _side(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, f"{root}/side"):
        return spark.createDataFrame([], struct_of(SIDE))
    return spark.read.schema(struct_of(SIDE)).option("basePath", f"{root}/side").parquet(f"{root}/side/commit=*")


def _rows(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], struct_of(ROWS))
    return spark.read.schema(struct_of(ROWS)).option("basePath", f"{root}/rows").parquet(*[f"{root}/rows/{f}" for f in folders])


def read_evidence(spark: SparkSession, root: str) -> DataFrame:
    """All stored raw sources with their ``content_hash``."""
    commits = [r["commit"] for r in _side(spark, root).select("commit").distinct().collect()]
    return _rows(spark, root, [f"commit={c}" for c in commits]).drop("commit", "bucket")


def files_that_may_hold(spark: SparkSession, root: str, hashes: DataFrame, buckets: int = BUCKETS) -> list[str]:
    """Folders whose bitmap has a bit of one of the hashes."""
    side = _side(spark, root)
    asked = hashes.select("content_hash", _bucket(F.col("content_hash"), buckets).alias("bucket"))
    held = side.select("commit", "bucket", "blocks").distinct()
    places = asked.join(held, "bucket").withColumn("at", _bit(F.col("content_hash"), F.col("blocks"))).select(
        "commit", "bucket", F.floor(F.col("at") / BLOCK_BITS).cast("long").alias("block"), (F.col("at") % BLOCK_BITS).alias("at")
    ).distinct()
    is_set = F.expr("shiftright(cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) & 1 = 1")
    hits = places.join(side.select("commit", "bucket", "block", "bits"), ["commit", "bucket", "block"]).where(is_set)
    return sorted(f"commit={r['commit']}/bucket={r['bucket']}" for r in hits.select("commit", "bucket").distinct().collect())


def append_evidence_once(spark: SparkSession, root: str, fresh: DataFrame, buckets: int = BUCKETS) -> int:
    """Add the raw sources whose content is not stored yet, and say how many folders of stored rows were looked into.

    ``fresh`` has the columns of raw sources; its ids are not used: new rows get the ids after the largest stored one, in order of
    ``created_at`` (ties: content hash). Of rows with the same content the earliest is kept. Appending a batch again changes nothing,
    so a job that failed is simply run again. One writer at a time.
    """
    names = [f.name for f in struct_of(RAW_SOURCES)]
    # Hashes are made again from stored rows and shuffled as bytes: as text they would be most of what is written.
    keyed = cut_lineage(fresh.select(*names)).withColumn("_hash", F.unhex(evidence_hash()))
    hashes = cut_lineage(keyed.select("_hash").distinct()).select(F.lower(F.hex("_hash")).alias("content_hash"))
    maybe = files_that_may_hold(spark, root, hashes, buckets)
    held = _rows(spark, root, maybe).select(F.unhex("content_hash").alias("_hash"))
    # The earliest of equal rows by an aggregate, which combines before the shuffle, however many there are.
    order = F.struct(F.col("created_at").isNull(), "created_at", "id")
    new = keyed.join(held, "_hash", "left_anti").groupBy("_hash").agg(F.min_by(F.struct(*names), order).alias("row"))
    new = cut_lineage(new)
    if new.isEmpty():
        return len(maybe)
    top = _side(spark, root).agg(F.coalesce(F.max("top"), F.lit(0)).alias("top")).first()["top"]
    numbers = number_rows(new.select("_hash", F.col("row.created_at").alias("created_at")), [F.asc_nulls_last("created_at"), "_hash"], "_no", top)
    rows = new.join(numbers.select("_hash", "_no"), "_hash").withColumn("content_hash", F.lower(F.hex("_hash"))).select(
        F.col("_no").alias("id"), *[F.col(f"row.{c}").alias(c) for c in names if c != "id"], "content_hash", _bucket(F.col("content_hash"), buckets).alias("bucket")
    )
    commit = f"commit={top}-{uuid.uuid4().hex}"
    rows.write.partitionBy("bucket").parquet(f"{root}/rows/{commit}")
    stored = _rows(spark, root, [commit]).select("id", "content_hash", "bucket")
    sizes = stored.groupBy("bucket").agg(F.count("*").alias("rows"), F.max("id").alias("top")).withColumn(
        "blocks", F.ceil(F.col("rows") * BITS_PER_ROW / BLOCK_BITS).cast("long")
    )
    at = _bit(F.col("content_hash"), F.col("blocks"))
    side = stored.join(F.broadcast(sizes), "bucket").select("bucket", "rows", "blocks", "top", at.alias("at")).groupBy(
        "bucket", "rows", "blocks", "top", F.floor(F.col("at") / BLOCK_BITS).cast("long").alias("block")
    ).agg(F.bitmap_construct_agg(F.col("at") % BLOCK_BITS).alias("bits"))
    side.coalesce(1).write.parquet(f"{root}/side-{commit}")
    files, work = files_at(spark, f"{root}/side-{commit}")
    done = files_at(spark, f"{root}/side/{commit}")[1]
    files.mkdirs(done.getParent())
    if not files.rename(work, done):
        raise RuntimeError(f"{work.toString()} could not be renamed to {done.toString()}")
    return len(maybe)
