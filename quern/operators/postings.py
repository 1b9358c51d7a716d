"""Inverted index: postings, lexicon and vector norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weight(tf: Column, df: Column, n: Column | float) -> Column:
    """(1 + log10 tf) * log10(N / df)."""
    return (1 + F.log10(tf)) * F.log10(F.lit(n) / df if not isinstance(n, Column) else n / df)


def term_rows(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, term) of (doc_id, terms): one row a token."""
    return tokens.select("doc_id", F.posexplode("terms").alias("pos", "term"))


def unigram_postings(weighted: DataFrame) -> DataFrame:
    """(term, doc_id, tfw, positions) of (term, doc_id, w, pos): one shuffle; pos is null outside the body."""
    return weighted.groupBy("term", "doc_id").agg(F.sum("w").cast("long").alias("tfw"), F.sort_array(F.collect_list("pos")).alias("positions"))


def bigram_postings(bigrams: DataFrame) -> DataFrame:
    """(bigram, doc_id, tf) of (doc_id, bigrams)."""
    return bigrams.select("doc_id", F.explode("bigrams").alias("bigram")).groupBy("bigram", "doc_id").agg(F.count("*").alias("tf"))


def lexicon(postings: DataFrame, key: str) -> DataFrame:
    return postings.groupBy(key).agg(F.count("*").alias("df"))


def by_document(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, terms, tfw, positions) of the postings of some terms (term): a row for each document."""
    rows = postings.join(terms, "term", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("term", "tfw", "positions")).alias("p"))
    return rows.select("doc_id", F.col("p.term").alias("terms"), F.col("p.tfw").alias("tfw"), F.col("p.positions").alias("positions"))


#: A term's postings are spread over so many tasks where they meet its df.
SALTS = 16


def norms(postings: DataFrame, key: str, tf: str, n: int) -> DataFrame:
    """(doc_id, norm): root of the summed squared weights of the terms that not every document has; 1 where that is 0.

    The postings are spread by (term, salt), counted there, and meet the summed counts where they are, so a term that a third
    of the documents have is no task of its own."""
    spread = postings.select(key, "doc_id", tf, F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt")).repartition(key, "salt")
    parts = spread.groupBy(key, "salt").agg(F.count("*").alias("some"))
    totals = parts.groupBy(key).agg(F.sum("some").alias("df"), F.collect_list("salt").alias("salts")).where(F.col("df") != n).select(key, "df", F.explode("salts").alias("salt"))
    w = weight(F.col(tf), F.col("df"), float(n))
    squares = spread.join(totals, [key, "salt"]).groupBy("doc_id").agg(F.sum(w * w).alias("s"))
    return squares.select("doc_id", F.when(F.col("s") > 0, F.sqrt("s")).otherwise(F.lit(1.0)).alias("norm"))
