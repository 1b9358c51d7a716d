"""The link graph's share in the index: words of incoming links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def url_owners(urls: DataFrame) -> DataFrame:
    """(nurl, owner) of (doc_id, nurl): the smallest id with an address."""
    return urls.where("nurl <> ''").groupBy("nurl").agg(F.min("doc_id").alias("owner"))


def anchor_terms(links: DataFrame, owners: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, term, n) of (doc_id, target, terms): words of the links that lead to a known page, given to the canonical document of
    that page. Links of duplicates count, so do repeated links and those to the page itself."""
    found = links.join(owners.withColumnRenamed("nurl", "target"), "target").select(F.col("owner").alias("doc_id"), "terms")
    canonical = F.coalesce("canonical_id", "doc_id").alias("doc_id")
    rows = found.join(mapping.select("doc_id", "canonical_id"), "doc_id", "left").select(canonical, F.explode("terms").alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
