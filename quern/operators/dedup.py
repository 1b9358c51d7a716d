"""Exact and near duplicates, and which document stands for each.

Documents come in id order; one is canonical if no earlier canonical document has a fingerprint that shares a band of 16 bits
with its own and differs in at most ``max_hamming`` bits. That set is the lexicographically first maximal independent set of
the graph of such pairs, found in parallel rounds (Blelloch, Fineman, Shun, "Greedy Sequential Maximal Independent Set and
Matching are Parallel on Average", SPAA 2012).

Equal fingerprints are one vertex, so copies cost no edge. A shared band leaves 48 bits, of which at most five may differ: of
their six bytes one at least is equal, so candidates are joined on (band, byte), whose buckets are 256 times smaller than a
band's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import band, hamming64
from ..storage import written

def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, first_id) of (doc_id, sha): the smallest id with the same fingerprint."""
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "sha").select("doc_id", "sha", "first_id")


def bands(fps: DataFrame) -> DataFrame:
    """(doc_id, fp, band, band_value)."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), band(F.col("fp"), k).alias("band_value")) for k in range(4))))
    return fps.select("doc_id", "fp", each.alias("b")).select("doc_id", "fp", "b.band", "b.band_value")


def _keyed(fps: DataFrame, max_hamming: int) -> DataFrame:
    """The rows of (fp, ..), once for each key: fingerprints that share a band and differ in at most ``max_hamming`` bits share one."""
    if not 0 <= max_hamming <= 5:
        raise ValueError("max_hamming must be from 0 to 5: beyond that a shared byte isn't certain")
    keys = []
    for k in range(4):
        for byte in (j for j in range(8) if j // 2 != k):
            value = F.shiftrightunsigned("fp", 8 * byte).bitwiseAND(F.lit(255))
            keys.append((F.lit(k * 8 + byte) * F.lit(1 << 24) + band(F.col("fp"), k) * F.lit(256) + value).cast("long"))
    return fps.withColumn("key", F.explode(F.array(*keys)))


def _spread(rows: DataFrame) -> DataFrame:
    """One side of a join that both sides are moved for: these sides grow with the documents, and each of the many rounds would build
    another table of one in the driver's memory to broadcast it."""
    return rows.hint("merge")


def near_edges(fps: DataFrame, max_hamming: int = 5) -> DataFrame:
    """(a, b, fp_a, fp_b, dist), a < b: different fingerprints that share a band and differ in at most ``max_hamming`` bits (at
    most 5). a and b are the smallest ids with them."""
    keyed = _keyed(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), max_hamming)
    other = keyed.select(F.col("id").alias("b"), F.col("fp").alias("fp_b"), "key")
    dist = hamming64(F.col("fp_a"), F.col("fp_b"))
    return (
        keyed.select(F.col("id").alias("a"), F.col("fp").alias("fp_a"), "key")
        .join(_spread(other), "key")
        .where((F.col("a") < F.col("b")) & (dist <= max_hamming))
        .select("a", "b", "fp_a", "fp_b", dist.cast("int").alias("dist"))
        .distinct()
    )


def near_canonical(reps: DataFrame, canonical: DataFrame, max_hamming: int = 5) -> DataFrame:
    """(fp, canonical_id, dist) of reps (id, fp) and canonical (id, fp): the canonical fingerprints near each one, or equal to it."""
    other = _keyed(canonical.select(F.col("id").alias("canonical_id"), "fp"), max_hamming).withColumnRenamed("fp", "fp_c")
    dist = hamming64(F.col("fp"), F.col("fp_c"))
    return _keyed(reps.select("fp"), max_hamming).join(_spread(other), "key").where(dist <= max_hamming).select("fp", "canonical_id", dist.cast("int").alias("dist")).distinct()


def duplicates_of_fixpoint(edges: DataFrame) -> DataFrame:
    """(id): the vertices that aren't in the first maximal independent set of edges (a, b), a < b. Each round settles the smallest
    open vertex at least, so it ends; each writes what is left as a table."""
    open_edges = edges.select("a", "b")
    found = None
    while not open_edges.isEmpty():
        first = open_edges.select("a").distinct().join(_spread(open_edges.select(F.col("b").alias("a"))), "a", "left_anti")
        hit = written(open_edges.join(_spread(first), "a").select(F.col("b").alias("id")).distinct(), "hit")
        found = hit if found is None else found.unionByName(hit)
        rest = open_edges.join(_spread(hit.withColumnRenamed("id", "a")), "a", "left_anti").join(_spread(hit.withColumnRenamed("id", "b")), "b", "left_anti")
        open_edges = written(rest, "open")
    return found if found is not None else edges.select(F.col("b").alias("id")).limit(0)


#: Representatives that are settled first, and by how much each following block of them is larger.
FIRST_BLOCK, BLOCK_GROWTH = 4096, 4


def canonical_ids(reps: DataFrame, max_hamming: int = 5) -> DataFrame:
    """(id, fp) of the first maximal independent set of reps (id, fp), block by block in the order of ids: what is near a canonical
    document of the blocks before leaves its block before its edges are listed. So a group of m documents that are all near to each other
    costs m pairs and not m * m."""
    fractions, n, size = [], reps.count(), FIRST_BLOCK
    while size < n:
        fractions.append(size / n)
        size *= BLOCK_GROWTH
    bounds = [None, *sorted(set(reps.approxQuantile("id", fractions, 0.001 if n < 100 * FIRST_BLOCK else FIRST_BLOCK / n / 10) if fractions else [])), None]
    canonical = None
    for low, high in zip(bounds, bounds[1:]):
        block = reps
        if low is not None:
            block = block.where(F.col("id") > int(low))
        if high is not None:
            block = block.where(F.col("id") <= int(high))
        if canonical is not None:
            block = written(block.join(_spread(near_canonical(block, canonical, max_hamming).select("fp")), "fp", "left_anti"), "block")
        edges = written(near_edges(block.withColumnRenamed("id", "doc_id"), max_hamming).select("a", "b"), "edges")
        own = written(block.join(_spread(duplicates_of_fixpoint(edges)), "id", "left_anti").select("id", "fp"), "canonical")
        canonical = own if canonical is None else canonical.unionByName(own)
    return canonical


def canonical_map(fps: DataFrame, max_hamming: int = 5) -> DataFrame:
    """(doc_id, canonical_id, dist) for every document: itself, or the closest earlier canonical document, of equally close ones
    the smallest id."""
    fps = written(fps, "fps")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "reps")
    near = near_canonical(reps, canonical_ids(reps, max_hamming), max_hamming)
    return (
        fps.join(_spread(near), "fp")
        .where("canonical_id <= doc_id")
        .groupBy("doc_id")
        .agg(F.min(F.struct(F.when(F.col("canonical_id") == F.col("doc_id"), -1).otherwise(F.col("dist")).alias("d"), F.col("canonical_id"), F.col("dist"))).alias("m"))
        .select("doc_id", "m.canonical_id", "m.dist")
    )


def duplicate_urls(mapping: DataFrame, urls: DataFrame) -> DataFrame:
    """(canonical_id, dup_urls): addresses of each canonical document's duplicates in id order."""
    rows = mapping.where("doc_id <> canonical_id").join(urls, "doc_id")
    return rows.groupBy("canonical_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "url"))), lambda x: x.url).alias("dup_urls"))


def latest_rows(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row for each key: the first by the given order."""
    return rows.withColumn("_turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_turn = 1").drop("_turn")
