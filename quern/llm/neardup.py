"""Near-duplicate sets by min-max hashing.

Under each of some random permutations the smallest and the largest hash of a set are both kept, so one evaluation
gives two values, each equal for two sets with the probability of their Jaccard similarity (Ji et al., "Min-Max Hash for
Jaccard Similarity", ICDM 2013). ``ROWS`` values make a band; sets that agree in a whole band are candidates, and candidates
are verified on the sets themselves. With 64 bands of 5 values a pair of similarity 0.6 is found with a probability of 0.994,
one of 0.7 with 0.99999, one of 0.1 becomes a candidate with 0.0006.

For short sets there is an exact way instead: sets that are alike enough share one of their first few elements, rarest first
(prefix filter), so the sets that do are all the candidates there can be.

Equal sets are represented by the smallest id before banding, so copies of one text, however many, cost one row and no
pair; ``expand`` gives them back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import keep, written

BANDS, ROWS = 64, 5
#: Sets of a band up to which they are paired by it.
MOST = 1_000

_RANDOM = np.random.default_rng(20_130_101)
_A = _RANDOM.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**63, 4096, dtype=np.uint64)


def _spread(x: np.ndarray) -> np.ndarray:
    """Mixes all bits, so that a linear function of it permutes well (finaliser of a 64-bit hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def band_keys(elements: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """``bands`` keys of a non-empty set of 32-bit element hashes; bands * rows is even and at most 8192."""
    n = bands * rows // 2
    x = _spread(elements.astype(np.uint64))
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(n, np.uint64)
    for at in range(0, len(x), 256):  # bounded memory for sets of any size
        values = x[at : at + 256, None] * _A[None, :n] + _B[None, :n]
        np.minimum(least, values.min(axis=0), out=least)
        np.maximum(most, values.max(axis=0), out=most)
    signature = np.concatenate([least, np.roll(most, 1)]).reshape(rows, bands).T  # shifted: no band holds both values of a permutation
    keys = (_spread(signature) * _A[None, -rows:]).sum(axis=1, dtype=np.uint64)
    return (_spread(keys + np.arange(bands, dtype=np.uint64))).view(np.int64)


def representatives(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reps, members) of (id, elements array<int>, distinct and sorted): one id for each different set; members has id, rep."""
    tagged = sets.where("id is not null and size(elements) > 0").withColumn("same", F.xxhash64("elements", F.size("elements")))
    rep = tagged.groupBy("same").agg(F.min("id").alias("rep"))
    members = written(tagged.select("id", "same").join(rep, "same").select("id", "rep"), "members")
    return sets.join(members.where("id = rep").select("id"), "id", "left_semi"), members


def candidates(sets: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS, most: int = MOST) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs that agree in a band, each once. Of bands that more than ``most`` sets have, which say little
    and would make as many pairs as the square of that, the sets are compared by their rarest elements instead, which finds all
    that are alike."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), []
            elements = batch.column(1)
            ends, flat = elements.offsets.to_numpy(), elements.values.to_numpy()
            for k in range(len(ids)):
                keys.append(band_keys(flat[ends[k] : ends[k + 1]].view(np.uint32), bands, rows))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, bands)), pa.array(np.concatenate(keys))], names=["id", "key"])

    banded = sets.where("size(elements) > 0").select("id", "elements").mapInArrow(keyed, "id long, key long")
    banded = keep(banded.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key"))  # met by key four times, moved once
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    other = banded.withColumnRenamed("id", "id_b")
    few = banded.withColumnRenamed("id", "id_a").join(shared.where(F.col("n") <= most).select("key"), "key", "left_semi").join(other, "key").where("id_a < id_b").select("id_a", "id_b")
    if shared.where(F.col("n") > most).isEmpty():
        return few.distinct()
    crowded = banded.join(shared.where(F.col("n") > most).select("key"), "key", "left_semi").select("id").distinct()
    return few.unionByName(sharing(sets.join(crowded, "id", "left_semi"), threshold, now=False)).distinct()


def sharing(sets: DataFrame, threshold: float, now: bool = True) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs that share one of their rarest elements, each once; none of at least this similarity is left out.
    Of n elements at least threshold * n are common then, so the first n - that + 1 in any common order hold one of them. ``now``
    writes those elements to the shared folder first."""
    each = sets.select("id", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    owners = each.groupBy("e").agg(F.count("*").alias("owners"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy("owners", "e"))
    first = each.join(owners, "e").withColumn("turn", turn).where(F.col("turn") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).where("owners > 1")
    first = first.select("id", "n", "e")
    if now:
        first = written(first, "prefixes")
    a, b = (first.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), "e") for x in "ab")
    sized = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    return a.join(b, "e").where("id_a < id_b").where(sized).select("id_a", "id_b").distinct()


def similar_pairs(sets: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS, exact: bool = False, most: int = MOST) -> DataFrame:
    """(id_a, id_b, similarity) of the candidate pairs whose sets have at least this Jaccard similarity."""
    pairs = written(sharing(sets, threshold) if exact else candidates(sets, threshold, bands, rows, most), "candidates")
    needed = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    elements = sets.join(needed, "id", "left_semi").select("id", "elements")
    both = (
        pairs.join(elements.select(F.col("id").alias("id_a"), F.col("elements").alias("a")), "id_a")
        .join(elements.select(F.col("id").alias("id_b"), F.col("elements").alias("b")), "id_b")
        .withColumn("common", F.size(F.array_intersect("a", "b")))
        .withColumn("all", F.size("a") + F.size("b") - F.col("common"))
    )
    return both.where(F.col("common") >= threshold * F.col("all") - 1e-9).select("id_a", "id_b", (F.col("common") / F.col("all")).alias("similarity"))


def near_duplicates(sets: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS, exact: bool = False, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives, members): see ``similar_pairs`` and ``representatives``. ``exact`` is for short sets. Rows with a null id or without
    elements have no near duplicate. ``sets`` is read several times, so it should be a table; members and candidates are written to the
    shared folder, so that each is computed once and no plan holds the others."""
    reps, members = representatives(sets)
    return similar_pairs(reps, threshold, bands, rows, exact, most), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids, of similar and of equal sets."""
    links = pairs.select("id_a", "id_b").unionByName(members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep").alias("id_a"), F.col("rep").alias("id_b")))
    a = members.select(F.col("rep").alias("id_a"), F.col("id").alias("x"))
    b = members.select(F.col("rep").alias("id_b"), F.col("id").alias("y"))
    out = links.join(a, "id_a").join(b, "id_b").where("id_a <> id_b or x < y")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def word_sets(texts: DataFrame, n: int) -> DataFrame:
    """(id, elements, tag) of (id, text, tag long): the distinct n-word shingles as sorted 32-bit hashes; shorter texts have none."""
    import re

    word = re.compile(r"[^\W_]+")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hash32 = xxhash.xxh32_intdigest
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, parts = [0], []
                for text in batch.column(1).to_pylist():
                    ws = word.findall(text.lower()) if text else []
                    found = {hash32(" ".join(ws[i : i + n])) for i in range(len(ws) - n + 1)}
                    part = np.fromiter(found, np.uint32, len(found)).view(np.int32)
                    part.sort()
                    parts.append(part)
                    sizes.append(sizes[-1] + len(part))
                flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["id", "elements", "tag"])

    return texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), "tag").where("id is not null").mapInArrow(shingle, "id long, elements array<int>, tag long")


def value_sets(rows: DataFrame) -> DataFrame:
    """(id, elements) of (id, items array<string>): the distinct non-null items as sorted 32-bit hashes."""
    return rows.select("id", F.array_sort(F.array_distinct(F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: F.hash(x)))).alias("elements"))
