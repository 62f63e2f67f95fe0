"""Raw-source files as a stream into tables that keep a base and what each batch changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from contactmill.operators.extraction import extract_all
from contactmill.operators.intake import intake_records, parse_records
from contactmill.operators.linkage import lead_keys, linkage_records, placeholder_key, record_keys
from contactmill.session import cut_lineage
from contactmill.sources.deltas import Store, Version, bucket_of, exists
from contactmill.sources.tables import SCHEMAS, Tables, read_tables, struct_of


def stream_extract(raw: DataFrame) -> DataFrame:
    """Extraction alone needs no state: a plain streaming projection."""
    return extract_all(raw)


def open_store(spark, root: str) -> tuple[Store, Version]:
    """The store under ``root``; a first one is made from the tables in ``root/v0``."""
    store = Store(spark, root)
    version = store.last()
    if version is None:
        start = read_tables(spark, f"{root}/v0") if exists(spark, f"{root}/v0") else _nothing(spark)
        version = store.create(start, lead_keys(start.leads).select("key", "id"))
    return store, version


def read_stored(spark, root: str) -> Tables:
    """The tables as the last complete batch left them."""
    return Store(spark, root).tables()


def _nothing(spark) -> Tables:
    return Tables(**{name: spark.createDataFrame([], struct_of(ddl)) for name, ddl in SCHEMAS.items()})


def _buckets(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that hold the keys: at most ``buckets`` numbers."""
    return [r["b"] for r in keys.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect()]


def _changed(after: DataFrame, before: DataFrame) -> DataFrame:
    """Rows that are new or differ from the row of the same id."""
    def print_of(df: DataFrame) -> Column:
        return F.xxhash64(*[F.col(c) for c in df.columns])

    old = before.select(F.col("id").alias("_id"), print_of(before).alias("_print"))
    return after.withColumn("_now", print_of(after)).join(old, F.col("id") == F.col("_id"), "left").where(
        F.col("_print").isNull() | (F.col("_print") != F.col("_now"))
    ).drop("_id", "_print", "_now")


def apply_batch(store: Store, now: Version, batch: DataFrame, made_by: str) -> Version:
    """The next version of the tables after a batch of raw sources.

    Names, sites and addresses of the batch are looked up in ``lead_keys``; only the buckets of the keys, of the leads
    found and of their people are read. Written are the leads and people that changed and the new rows. Raw sources whose id
    is stored already are passed over, so a batch that comes twice under another name changes nothing.
    """
    spark = batch.sparkSession
    held = store.read(now, "raw_sources", _buckets(batch, "id", now.buckets)).select(F.col("id").alias("_id"))
    fresh = batch.join(held, F.col("id") == F.col("_id"), "left_anti")
    records = cut_lineage(parse_records(fresh))
    if records.isEmpty():
        return store.append(now, {}, made_by)
    linking = linkage_records(records)
    carried = cut_lineage(
        record_keys(linking).select("key").unionByName(
            linking.where("name_key IS NULL").select(F.concat(F.lit("n:"), placeholder_key(F.col("source_type"))).alias("key"))
        ).distinct()
    )
    found = store.read(now, "lead_keys", _buckets(carried, "key", now.buckets)).join(carried, "key", "left_semi").select(F.col("id").alias("_lead")).distinct()
    found = cut_lineage(found)
    leads = store.read(now, "leads", _buckets(found, "_lead", now.buckets)).join(found, F.col("id") == F.col("_lead"), "left_semi")
    leads = cut_lineage(leads)
    people = store.read(now, "people", _buckets(found, "_lead", now.buckets)).join(found, F.col("lead_id") == F.col("_lead"), "left_semi")
    people = cut_lineage(people)
    after = intake_records(records, _nothing(spark).with_(leads=leads, people=people), now.tops)
    new_leads = cut_lineage(_changed(after.leads, leads))
    return store.append(
        now,
        {
            "leads": new_leads, "people": _changed(after.people, people), "raw_sources": after.raw_sources,
            "interactions": after.interactions, "tasks": after.tasks, "lead_keys": lead_keys(new_leads).select("key", "id"),
        },
        made_by,
    )


def stream_intake(raw: DataFrame, root: str) -> DataStreamWriter:
    """Run the intake job per micro-batch on the tables under ``root`` (``read_stored`` reads them).

    ``root/v0`` is the starting state, if there is one. A batch writes what it changed and commits it by one rename, with
    its query and number; after a failure the same batch finds its commit and does nothing, and files without a commit
    are never read. A commit of another query (after a checkpoint was lost, say) is an error: no input is
    passed over. Small commits are put together in passing.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        store, now = open_store(spark, root)
        if now.made_by != "create":
            writer, _, done = now.made_by.rpartition(" ")
            if writer != query:
                raise RuntimeError(f"{root} was made by {writer}, not by {query}: start from a root without a log")
            if int(done) >= batch_id:
                return
        store.compact(apply_batch(store, now, batch, f"{query} {batch_id}"))

    return raw.writeStream.foreachBatch(apply)
