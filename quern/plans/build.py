"""Building, saving and loading an index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..config import EngineConfig
from ..functions.hashing import simhash64
from ..functions.text import bigrams, tokens
from ..operators import dedup, links, postings, search
from ..storage import written

_ZONES = "doc_id long, url string, nurl string, body string, title string, head string, bold string, links array<struct<target:string,text:string>>"


def parse_zones(pages: DataFrame) -> DataFrame:
    """Zones, links and the normalised address of (doc_id, path, url, source); pages without a source are left out."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.html import parse_page
        from ..functions.urls import normalize_url, without_fragment

        link = pa.struct([("target", pa.string()), ("text", pa.string())])
        kinds = pa.schema([("doc_id", pa.int64()), *((k, pa.string()) for k in ("url", "nurl", "body", "title", "head", "bold")), ("links", pa.list_(link))])
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                rows: list[list] = [[] for _ in kinds]
                for doc, url, source in zip(*(whole.slice(at, 500).column(k).to_pylist() for k in range(3))):
                    url = without_fragment(url)
                    page = parse_page(source, url)
                    for column, value in zip(rows, (doc, url, normalize_url(url), page["body"], page["title"], page["head"], page["bold"], [{"target": t, "text": x} for t, x in page["links"]])):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(rows, kinds)], schema=kinds)

    return pages.where("source is not null").select("doc_id", "url", "source").mapInArrow(parse, _ZONES)


def stem_terms(rows: DataFrame, column: str) -> DataFrame:
    """Stems an array of terms where it lies; each worker stems a word once, so no common word is moved or met again."""
    from ..functions.porter import stem

    @F.pandas_udf(ArrayType(StringType()))
    def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = lru_cache(maxsize=500_000)(stem)
        for lists in batches:
            yield lists.map(lambda ws: [known(w) for w in ws], na_action="ignore")

    return rows.withColumn(column, F.coalesce(stemmed(column), F.array().cast("array<string>")))


def texts_as_pages(documents: DataFrame) -> DataFrame:
    """Plain texts in the form of parsed pages: all body, no links."""
    none = F.lit("")
    return documents.where("doc_id is not null").select(
        "doc_id", F.coalesce("url", none).alias("url"), F.coalesce("url", none).alias("nurl"), F.coalesce("text", none).alias("body"), none.alias("title"), none.alias("head"), none.alias("bold"),
        F.array().cast("array<struct<target:string,text:string>>").alias("links"),
    )


@dataclass
class Index:
    config: EngineConfig
    postings: DataFrame
    bigrams: DataFrame
    lexicon: DataFrame
    lexicon2: DataFrame
    docinfo: DataFrame
    canonical_map: DataFrame
    stats: DataFrame  # one row: n_paths, n_indexed, n_docinfo

    _TABLES = ("postings", "bigrams", "lexicon", "lexicon2", "docinfo", "canonical_map", "stats")

    def save(self, path: str) -> None:
        """Tables in Parquet, postings in ranges of terms with a bloom filter, so a lookup reads few row groups."""
        for name in self._TABLES:
            table = getattr(self, name)
            key = {"postings": "term", "lexicon": "term", "bigrams": "bigram", "lexicon2": "bigram"}.get(name)
            if key:
                order = [key, "doc_id"] if "doc_id" in table.columns else [key]
                table = table.repartitionByRange(key).sortWithinPartitions(*order)
            writer = table.write.mode("overwrite").option("compression", "zstd")
            if key:
                writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
            writer.parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> Index:
        """A missing or unreadable bigram index is an empty one; the other tables must be there."""
        empty = {"bigrams": "bigram string, doc_id long, tf long", "lexicon2": "bigram string, df long"}
        tables = {}
        for name in cls._TABLES:
            try:
                tables[name] = spark.read.parquet(f"{path}/{name}")
            except Exception:
                if name not in empty:
                    raise
                tables[name] = spark.createDataFrame([], empty[name])
        return cls(config, **tables)

    def lookup(self, *terms: str | DataFrame) -> DataFrame:
        """(term, df, doc_id, tfw, positions) of the given terms, found by their ranges and bloom filters, or of a table (term)."""
        if len(terms) == 1 and isinstance(terms[0], DataFrame):
            asked = terms[0].select("term").distinct()
            return self.postings.join(asked, "term", "left_semi").join(self.lexicon.join(asked, "term", "left_semi"), "term")
        return self.postings.where(F.col("term").isin(*terms)).join(self.lexicon.where(F.col("term").isin(*terms)), "term")

    def register_views(self, prefix: str = "index_") -> None:
        for name in self._TABLES:
            getattr(self, name).createOrReplaceTempView(prefix + name)

    def tables(self) -> search.SearchTables:
        n = self.stats.first()["n_docinfo"]
        return search.SearchTables(self.postings, self.bigrams, self.lexicon, self.lexicon2, self.docinfo, n)

    def search(self, queries: DataFrame | list[str] | str, k: int | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score, url, candidates) of a table (query_id, text), a list of texts or one text."""
        spark = self.postings.sparkSession
        if isinstance(queries, str):
            queries = [queries]
        if isinstance(queries, list):
            queries = spark.createDataFrame(list(enumerate(queries, 1)), "query_id long, text string")
        asked = queries.select("query_id", tokens(F.col("text")).alias("terms"))
        if self.config.stem:
            asked = stem_terms(asked, "terms")
        if self.config.phrase_docs is None and self.config.max_candidates is None:
            return search.ranked_all(asked, self.tables(), self.config, k or self.config.top_k)
        return search.ranked(search.scored_candidates(asked, self.tables(), self.config), self.docinfo, k or self.config.top_k)

    def cached(self) -> Index:
        return replace(self, **{name: keep_always(getattr(self, name)) for name in self._TABLES})


def keep_always(df: DataFrame) -> DataFrame:
    return df.persist()


def build_index(parsed: DataFrame, config: EngineConfig = EngineConfig(), n_paths: int | None = None) -> Index:
    """Index of parsed pages (``parse_zones`` or ``texts_as_pages``); n_paths counts unreadable pages too."""
    pages = parsed.select("doc_id", "url", "nurl", "links", "body", *(tokens(F.col(z)).alias(z + "_terms") for z in ("body", "title", "head", "bold")))
    if config.stem:
        zones = ("body_terms", "title_terms", "head_terms", "bold_terms")
        ends = [sum((F.size(z) for z in zones[:k]), F.lit(1)) for k in range(4)]
        pages = stem_terms(pages.withColumn("all_terms", F.concat(*zones)), "all_terms")
        pages = pages.select("doc_id", "url", "nurl", "links", *(F.slice("all_terms", ends[k], F.size(z)).alias(z) for k, z in enumerate(zones)))
    pages = written(pages, "pages")
    counts = pages.select("doc_id", F.explode("body_terms").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    mapping = written(dedup.canonical_map(simhash64(counts, pages.select("doc_id")), config.max_hamming).select("doc_id", "canonical_id"), "mapping")
    canonical = pages.join(mapping.where("doc_id = canonical_id").select("doc_id"), "doc_id", "left_semi")
    anchors = pages.select("doc_id", F.explode("links").alias("l")).select("doc_id", F.col("l.target").alias("target"), tokens(F.col("l.text")).alias("terms"))
    if config.stem:
        anchors = stem_terms(anchors, "terms")
    incoming = links.anchor_terms(anchors, links.url_owners(pages.select("doc_id", "nurl")), mapping)
    none = F.lit(None).cast("int")
    weighted = canonical.select("doc_id", F.posexplode("body_terms").alias("pos", "term")).select("term", "doc_id", F.lit(1).cast("long").alias("w"), "pos")
    for zone, w in (("title", config.w_title), ("head", config.w_head), ("bold", config.w_bold)):
        weighted = weighted.unionByName(canonical.select("doc_id", F.explode(zone + "_terms").alias("term")).select("term", "doc_id", F.lit(w).cast("long").alias("w"), none.alias("pos")))
    own = incoming.join(mapping.where("doc_id = canonical_id").select("doc_id"), "doc_id", "left_semi")
    weighted = weighted.unionByName(own.select("term", "doc_id", (config.w_anchor * F.col("n")).alias("w"), none.alias("pos")))
    unigrams = written(postings.unigram_postings(weighted), "postings")
    pairs = written(postings.bigram_postings(canonical.select("doc_id", bigrams(F.col("body_terms")).alias("bigrams"))), "bigrams")
    lex, lex2 = written(postings.lexicon(unigrams, "term"), "lexicon"), written(postings.lexicon(pairs, "bigram"), "lexicon2")
    n_pages = pages.count()
    n_docinfo = mapping.where("doc_id = canonical_id").count()
    n_indexed = n_docinfo + max(0, (n_paths or n_pages) - n_pages)
    one, two = postings.norms(unigrams, "term", "tfw", n_indexed), postings.norms(pairs, "bigram", "tf", n_indexed).withColumnRenamed("norm", "norm2")
    dups = dedup.duplicate_urls(mapping, pages.select("doc_id", "url")).withColumnRenamed("canonical_id", "doc_id")
    docinfo = (
        canonical.select("doc_id", "url")
        .join(one, "doc_id", "left")
        .join(two, "doc_id", "left")
        .join(dups, "doc_id", "left")
        .select("doc_id", "url", F.coalesce("norm", F.lit(1.0)).alias("norm"), F.coalesce("norm2", F.lit(1.0)).alias("norm2"), F.coalesce("dup_urls", F.array().cast("array<string>")).alias("dup_urls"))
    )
    stats = parsed.sparkSession.createDataFrame([(n_paths or n_pages, n_indexed, n_docinfo)], "n_paths long, n_indexed long, n_docinfo long")
    return Index(config, unigrams, pairs, lex, lex2, written(docinfo, "docinfo"), mapping, stats)

