"""How distinctive a term is for a record, against the whole collection.

``dfr`` is divergence from randomness (Amati and van Rijsbergen, ACM TOIS 2002), model G L 2: the information content of the
length-normalised frequency under the geometric limit of Bose-Einstein statistics, times the gain of Laplace's law of
succession:

    tfn = tf * log2(1 + average length / length)        lambda = F / N
    weight = (log2(1 + lambda) + tfn * log2((1 + lambda) / lambda)) / (tfn + 1)

``tfidf`` is (1 + log10 tf) * log10(N / df). Both come from the same counts: F and df are taken over all different
(term, record) pairs, N over all different records of the collection.

Repeated rows count once, with the largest tf; rows whose tf is null or below 1 count for df only. Terms or records that are
null are left out. Ties go to the smaller term.

Scale: one shuffle of the postings by (term, salt), where the salt is a hash of the record, removes repeats, counts df and meets
the totals of the terms again, so a term that a third of the records have is spread over ``SALTS`` tasks; the best term of a
record is a partial aggregate. Only the divergence needs the records' lengths, so the TF-IDF weight alone costs no join on records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def score_terms(postings: DataFrame, records: DataFrame, divergence: bool = True) -> DataFrame:
    """(doc_id, term, tf, df, tfidf, dfr) of postings (term, doc_id, tfw); N is the number of different doc_ids of records. Without
    ``divergence`` there is no column dfr."""
    n = max(1, records.where("doc_id is not null").select("doc_id").distinct().count())
    tf = F.max(F.when(F.col("tfw") > 0, F.col("tfw"))).cast("long")
    rows = postings.where("term is not null and doc_id is not null").select("term", "doc_id", "tfw", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"))
    pairs = rows.repartition("term", "salt").groupBy("term", "salt", "doc_id").agg(tf.alias("tf"))
    per_salt = pairs.groupBy("term", "salt").agg(F.count("*").alias("df"), F.sum("tf").alias("f"))
    totals = per_salt.groupBy("term").agg(F.sum("df").alias("df"), F.sum("f").alias("f"), F.collect_list("salt").alias("salts")).select("term", "df", "f", F.explode("salts").alias("salt"))
    scored = pairs.where("tf is not null").join(totals, ["term", "salt"])
    tfidf = ((1 + F.log10("tf")) * F.log10(F.lit(float(n)) / F.col("df"))).alias("tfidf")
    if not divergence:
        return scored.select("doc_id", "term", "tf", "df", tfidf)
    length = pairs.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    # one number for the collection: the average length
    average = (length.agg(F.sum("length")).first()[0] or 0) / n
    tfn = F.col("tf") * F.log2(1 + F.lit(float(average)) / F.col("length"))
    rate = F.col("f") / F.lit(float(n))
    dfr = ((F.log2(1 + rate) + tfn * F.log2((1 + rate) / rate)) / (tfn + 1)).alias("dfr")
    return scored.join(length, "doc_id").select("doc_id", "term", "tf", "df", tfidf, dfr)


def best_term(scored: DataFrame, weight: Column) -> DataFrame:
    """(doc_id, term, weight): of each record the term of greatest weight, of equal ones the smallest."""
    return scored.groupBy("doc_id").agg(F.min_by("term", F.struct(-weight, F.col("term"))).alias("term"), F.max(weight).alias("weight"))
