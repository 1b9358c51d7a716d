"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

The ledger is a table of (bucket, key, copies, first_id) in a folder, one subfolder for each bucket and version, and a manifest
for each version that names the current subfolder of every bucket. A batch of (key, id) rows is pre-aggregated to one row a
key, full-outer-joined on (bucket, key) with the ledger's rows of the buckets it touches, counts are added, the earliest
representative stays, and the touched buckets are written anew; the others are carried over by reference. The manifest is
written last, so a batch that fails leaves the ledger as it was, and a ledger that is opened again goes on from its last
version. The number of buckets is chosen from the first batch, ``KEYS`` keys each, and doubled by rewriting the ledger when
buckets have grown to four times that. An id counts once in a batch; the same id in two batches counts twice, so batches
must not overlap.

A key with a third of all rows is one row after the partial aggregation; where its copies are listed, the few keys that own
a hundredth of the rows or more are joined by broadcast, so no task grows with them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import keep, shared_dir

#: Keys of a bucket when a ledger is begun.
KEYS = 1_000_000
#: Share of the rows from which a key's copies are joined by broadcast: at most 1 / HOT keys.
HOT = 0.01
_LEDGER = "key string, copies long, first_id long, bucket int"


def with_canonical_url(rows: DataFrame, url: str, name: str) -> DataFrame:
    """Adds the address apart from outer blanks, case of scheme and host, default port, fragment and order of parameters.

    Null for null, empty and blank addresses. What isn't of the form scheme://host... only loses blanks and fragment. Each part
    is a column of its own, so that none is computed twice."""
    blank = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+"
    form = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?]*)([^?]*)(\?.*)?$"
    part = lambda k: F.coalesce(F.get("_parts", k - 1), F.lit(""))
    query = F.array_join(F.array_sort(F.split(F.substring(part(4), 2, 1_000_000_000), "&")), "&")
    host = F.lower(F.regexp_replace(part(2), r"^.*@", ""))
    port = F.when(F.col("_scheme") == "http", r":(?:80)?$").when(F.col("_scheme") == "https", r":(?:443)?$").otherwise(r":$")
    return (
        rows.withColumn("_text", F.regexp_replace(F.regexp_replace(url, f"^{blank}|{blank}$", ""), r"(?s)#.*$", ""))
        .withColumn("_parts", F.split(F.regexp_replace("_text", form, "\u0002\u0001$1\u0001$2\u0001$3\u0001$4"), "\u0001"))  # the mark is there if the form is
        .withColumn("_formed", F.get("_parts", 0) == "\u0002")
        .withColumn("_parts", F.slice("_parts", 2, 1_000_000))
        .withColumn("_scheme", F.lower(part(1)))
        .withColumn("_place", F.concat(F.regexp_extract(part(2), r"^(.*@)?", 0), F.regexp_replace(host, port, F.lit(""))))
        .withColumn("_query", F.when(part(4) != "", F.concat(F.lit("?"), query)).otherwise(""))
        .withColumn(name, F.when(F.col("_text") == "", None).otherwise(F.when(F.col("_formed"), F.concat("_scheme", F.lit("://"), "_place", part(3), "_query")).otherwise(F.col("_text"))))
        .drop("_text", "_parts", "_formed", "_scheme", "_place", "_query")
    )


class Ledger:
    """Counts of canonical keys, kept up with batches and across runs: a path that holds a ledger is opened, not begun anew."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark).rstrip('/')}/quern-ledger-{uuid.uuid4().hex}"
        self.buckets = buckets
        self.files: dict[int, str] = {}  # bucket -> folder of its current version; at most ``buckets`` entries
        self.version = 0
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._open()

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _open(self) -> None:
        if not self._fs.exists(self._at(self.path)):
            return
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(self.path))]
        if not (versions := [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]):
            return
        self.version = max(versions)
        said = json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest-{self.version}.json").collect()))
        self.buckets, self.files = said["buckets"], {int(b): f"{self.path}/{folder}" for b, folder in said["files"].items()}

    def _close(self, files: dict[int, str]) -> None:
        """Makes a version current: written aside, then renamed."""
        text = json.dumps({"buckets": self.buckets, "files": {b: f[len(self.path) + 1 :] for b, f in files.items()}})
        aside, final = self._at(f"{self.path}/.manifest-{uuid.uuid4().hex}"), self._at(f"{self.path}/manifest-{self.version + 1}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if not self._fs.rename(aside, final):
            raise RuntimeError(f"another writer has added to {self.path}")
        self.version, self.files = self.version + 1, files

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in self.files.items() if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], _LEDGER)
        return self.spark.read.schema(_LEDGER).parquet(*paths)

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Writes whole buckets; their folders."""
        where = f"{self.path}/v{self.version + 1}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("b", F.col("bucket")).repartition("b").write.mode("errorifexists").partitionBy("b").option("compression", "zstd").parquet(where)
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(where))]
        return {int(n[2:]): f"{where}/{n}" for n in names if n.startswith("b=")}

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of (key, id); rows with a null key or id are left out, an id counts once in a batch."""
        rows = batch.where("key is not null and id is not null").select("key", "id").distinct()
        new = keep(rows.groupBy("key").agg(F.count("*").alias("more"), F.min("id").alias("its_first")))
        if not (keys := new.count()):
            return
        if self.buckets is None:
            self.buckets = max(1, -(-keys // KEYS))
        new = new.select("*", self._bucket())
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        merged = new.join(self.read(touched), ["bucket", "key"], "full_outer").select(
            "key", (F.coalesce("copies", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("copies"), F.least("first_id", "its_first").alias("first_id"), "bucket"
        )
        self._close(self.files | self._write(merged))
        if keys > 2 * KEYS * self.buckets or self.version % 16 == 0 and self.read().count() > 4 * KEYS * self.buckets:
            self.buckets *= 2
            self._close(self._write(self.read().select("key", "copies", "first_id", self._bucket())))


def duplicates_in(rows: DataFrame, batches: list[Column], path: str | None = None) -> tuple[DataFrame, Ledger]:
    """(counts, ledger) of (key, id) rows that come in the given batches, each a condition on ``rows``; counts has key,
    copies, first_id."""
    ledger = Ledger(rows.sparkSession, path)
    for batch in batches:
        ledger.add(rows.where(batch))
    counts = ledger.read().select("key", "copies", "first_id")
    return counts, ledger


def copies_of(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, first_id, copy_id): a row for each id but the first of its key. ``rows`` is read twice."""
    repeated = counts.where("copies > 1").select("key", "first_id", "copies")
    least = HOT * (counts.agg(F.sum("copies")).first()[0] or 0)
    hot, rest = F.col("copies") >= max(least, 2), F.col("copies") < max(least, 2)
    rows = rows.where("key is not null").select("key", "id")
    found = rows.join(F.broadcast(repeated.where(hot)), "key").unionByName(rows.join(repeated.where(rest), "key"))  # at most 1 / HOT keys
    return found.where("id <> first_id").select("key", "first_id", F.col("id").alias("copy_id")).distinct()
