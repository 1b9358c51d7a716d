"""Fingerprints: SHA-256 of normalised text, 64-bit hashes of terms, SimHash and its bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalised_space


def exact_fingerprint(text: Column) -> Column:
    return F.sha2(normalised_space(text), 256)


def hash64(term: Column) -> Column:
    """The first eight bytes of SHA-1 as a signed long."""
    return F.conv(F.substring(F.sha1(term), 1, 16), 16, -10).cast("long")


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(65535)).cast("int")


def simhash64(counts: DataFrame, spine: DataFrame) -> DataFrame:
    """(doc_id, fp) for every doc_id of the spine, from (doc_id, term, n): bit i is set where the weighted votes for it are not
    negative; a document without terms has 0. Sums of 64 votes in one partial aggregate."""
    h = hash64(F.col("term"))
    votes = counts.groupBy("doc_id").agg(*(F.sum(F.when(F.getbit(h, F.lit(i)) == 1, F.col("n")).otherwise(-F.col("n"))).alias(f"v{i}") for i in range(64)))
    bits = F.lit(0).cast("long")
    for i in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"v{i}") >= 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return spine.select("doc_id").join(votes.select("doc_id", bits.alias("fp")), "doc_id", "left").select("doc_id", F.coalesce("fp", F.lit(0).cast("long")).alias("fp"))
