"""The core tables as a base and what batches added: written bytes follow the batch, not the table.

    root/data/<table>/commit=<n>-<id>/bucket=<b>/...    rows of one commit, dealt by the hash of a key
    root/log/<n>.json                                    what version n consists of

A version is a small JSON text put in place by one rename, so a reader sees all of a commit or
nothing. Tables that only grow are the rows of all commits. Leads and people are updated by writing
the new row; a read takes the newest row of each id. ``lead_keys`` (key, id) finds leads by
name, site or address; entries of old names stay, since what they find is looked at again.
Small commits are put together when there are many, and into the base when they have grown beside it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.sources.tables import SCHEMAS, Tables, struct_of

BUCKETS = 32
# Commits of a table before the small ones are put together, and their share of the base's rows before all is written anew.
MOST_COMMITS, LARGEST_SHARE = 12, 0.5
LEAD_KEYS = "key string, id long"
UPDATED = {"leads", "people"}
BUCKET_KEY = {"people": "lead_id", "lead_keys": "key"}
ALL_SCHEMAS = {**SCHEMAS, "lead_keys": LEAD_KEYS}


def files_at(spark: SparkSession, path: str):
    """The file system of a path, and the path, on the JVM side."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = files_at(spark, path)
    return files.exists(target)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def hash_key(table: str) -> str:
    return BUCKET_KEY.get(table, "id")


@dataclass
class Part:
    """The rows of one commit of a table."""

    commit: str
    seq: int
    rows: int


@dataclass
class Version:
    """One state of the tables, as the log tells it."""

    number: int
    buckets: int
    made_by: str = ""
    parts: dict[str, list[Part]] = field(default_factory=dict)
    tops: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(self, default=vars)

    @staticmethod
    def of(text: str) -> Version:
        told = json.loads(text)
        told["parts"] = {t: [Part(**p) for p in parts] for t, parts in told["parts"].items()}
        return Version(**told)


class Store:
    """Reads and commits versions of the tables under a root. One writer at a time; a second one fails at its commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- log
    def last(self) -> Version | None:
        if not exists(self.spark, f"{self.root}/log"):
            return None
        files, folder = files_at(self.spark, f"{self.root}/log")
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        return self.version(max(numbers)) if numbers else None

    def version(self, number: int) -> Version:
        text = self.spark.read.text(f"{self.root}/log/{number}.json", wholetext=True).first()["value"]
        return Version.of(text)

    def commit(self, version: Version) -> None:
        """Put a version in place: the text is complete before its name exists."""
        files, done = files_at(self.spark, f"{self.root}/log/{version.number}.json")
        work = files_at(self.spark, f"{self.root}/log/{version.number}.{uuid.uuid4().hex}.part")[1]
        out = files.create(work, False)
        out.write(bytearray(version.text().encode()))
        out.close()
        if files.exists(done) or not files.rename(work, done):
            raise RuntimeError(f"{done.toString()} is there already: another writer was faster")

    # --- data
    def write(self, table: str, df: DataFrame, version: Version) -> Part | None:
        """Write the rows of one commit; nothing refers to them before the version is committed."""
        commit = f"{version.number}-{uuid.uuid4().hex}"
        path = f"{self.root}/data/{table}/commit={commit}"
        names = struct_of(ALL_SCHEMAS[table]).names
        df.select(*names, bucket_of(F.col(hash_key(table)), version.buckets).alias("bucket")).write.partitionBy("bucket").parquet(path)
        back = self._read(table, [commit])
        top = F.max("id") if table in SCHEMAS and table != "command_log" else F.lit(None).cast("long")
        told = back.agg(F.count("*").alias("n"), top.alias("top")).first()
        if told["top"] is not None:
            version.tops[table] = max(version.tops.get(table, 0), told["top"])
        return Part(commit, version.number, told["n"]) if told["n"] else None

    def _read(self, table: str, commits: list[str]) -> DataFrame:
        schema = struct_of(f"{ALL_SCHEMAS[table]}, commit string, bucket int")
        if not commits:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/data/{table}"
        present = [c for c in commits if exists(self.spark, f"{base}/commit={c}")]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/commit={c}" for c in present])

    def read(self, version: Version, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table; only the folders of ``buckets``, if they are given."""
        parts = version.parts.get(table, [])
        chosen = lambda df: df if buckets is None else df.where(F.col("bucket").isin(*buckets))
        if table not in UPDATED or len(parts) < 2:
            return chosen(self._read(table, [p.commit for p in parts])).drop("commit", "bucket")
        base, later = parts[0], parts[1:]
        old = chosen(self._read(table, [base.commit]))
        new = chosen(self._read(table, [p.commit for p in later]))
        # Every commit holds an id once. The base is only filtered by the ids written since, whose side is the small one.
        seq = F.create_map(*[F.lit(x) for p in later for x in (p.commit, p.seq)])[F.col("commit")]
        new = new.withColumn("_seq", seq)
        newest = new.groupBy(F.col("id").alias("_id")).agg(F.max("_seq").alias("_last"))
        kept = new.join(newest, (F.col("id") == F.col("_id")) & (F.col("_seq") == F.col("_last"))).drop("_id", "_last", "_seq")
        return old.join(newest, F.col("id") == F.col("_id"), "left_anti").unionByName(kept).drop("commit", "bucket")

    def tables(self, version: Version | None = None) -> Tables:
        version = version or self.last()
        return Tables(**{name: self.read(version, name) for name in SCHEMAS})

    # --- writes
    def create(self, tables: Tables, lead_keys: DataFrame, buckets: int = BUCKETS) -> Version:
        """Version 0 from whole tables."""
        first = Version(0, buckets, "create")
        for name in ALL_SCHEMAS:
            df = lead_keys if name == "lead_keys" else getattr(tables, name)
            if df is not None and (part := self.write(name, df, first)):
                first.parts[name] = [part]
        self.commit(first)
        return first

    def append(self, before: Version, changed: dict[str, DataFrame], made_by: str) -> Version:
        """The next version: rows that are new, or newer than those of the same id. Each id may occur once per table."""
        after = Version(before.number + 1, before.buckets, made_by, {t: list(p) for t, p in before.parts.items()}, dict(before.tops))
        for name, df in changed.items():
            if part := self.write(name, df, after):
                after.parts.setdefault(name, []).append(part)
        self.commit(after)
        return after

    def compact(self, before: Version, most_commits: int = MOST_COMMITS, largest_share: float = LARGEST_SHARE) -> Version:
        """Put the later commits of a table together once there are ``most_commits``, with the base too if they hold ``largest_share`` of its rows.

        Each row is so written a number of times that grows with the logarithm of the table. The same rows are read before and after.
        """
        due = {t: parts for t, parts in before.parts.items() if len(parts) > most_commits}
        if not due:
            return before
        after = Version(before.number + 1, before.buckets, before.made_by, dict(before.parts), dict(before.tops))
        for table, parts in due.items():
            later = parts[1:]
            if sum(p.rows for p in later) >= largest_share * parts[0].rows:
                whole = self.write(table, self.read(before, table), after)
                after.parts[table] = [whole]
                continue
            # Read without the base, the first of the later commits would pass for one: no row of it may be older than another's.
            some = Version(0, before.buckets, parts={table: [Part(later[0].commit, -1, 0), *later[1:]]})
            after.parts[table] = [parts[0], self.write(table, self.read(some, table), after)]
        self.commit(after)
        return after
