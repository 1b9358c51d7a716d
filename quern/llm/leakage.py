"""Evaluation texts leaking into training text: latent semantic retrieval of passages, then an exact check.

1. Passages are ``WINDOW`` successive words, every ``STRIDE`` words, so any run of ``RUN`` words lies whole in one.
2. TF-IDF: document frequencies of all words are counted over all passages of the corpus, once, and written; common words weigh
   little and none is left out.
3. A randomised SVD of the evaluation passages' TF-IDF matrix (range finder with power iterations; its products with the
   matrix are computed where the passages lie and summed) gives the latent space, of a rank of a ``SHARE``th of the passages.
4. Every corpus passage meets the evaluation passages through lists of the words they have; those that share enough weight are
   compared by cosine in the latent space. A run of common words may weigh too little for that, so pairs of passages with
   ``RUN`` words in common, however common, are checked as well: no shared run can be missed. The evaluation texts are a stated query set: they come in blocks of at most
   ``BLOCK`` items and ``BLOCK_WORDS`` words, of which the driver holds one at a time, so what is broadcast has a bound.
5. Pairs above ``COSINE`` are checked: the longest run of common successive words, and the longest common subsequence,
   which tells paraphrases. The items have no answers to check apart from their text.

Words are runs of letters and digits, case folded. Null and empty texts have no passage; texts shorter than ``RUN`` words
can't be hit. Of a repeated item_id the rows count as one text each.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

RUN = 13
WINDOW, STRIDE = 26, 13
COSINE = 0.3
SHARE, LEAST_RANK = 3, 64
POWER = 2
BLOCK, BLOCK_WORDS = 500, 30_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.casefold())


def windows(n: int) -> list[int]:
    """Starts of the passages of a text of n words."""
    if n <= WINDOW:
        return [0] if n else []
    return list(range(0, n - WINDOW + STRIDE, STRIDE))


def passage_df(corpus: DataFrame) -> DataFrame:
    """(w, n): how many passages of the corpus hold each word, and under "" how many passages there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, Counter()
        handed = lambda: pa.RecordBatch.from_pydict({"w": ["", *seen], "n": pa.array([total, *seen.values()], pa.int64())})
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ws = words(text)
                for at in windows(len(ws)):
                    total += 1
                    seen.update(set(ws[at : at + WINDOW]))
            if len(seen) > 200_000:
                yield handed()
                total = 0
                seen.clear()
        yield handed()

    return corpus.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def blocks_of(items: DataFrame) -> Iterator[dict[int, list[str]]]:
    """The items' words, in blocks that fit a broadcast; an item of more words than a block is a block by itself."""
    block: dict[int, list[str]] = {}
    size = 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if not (ws := words(r.text)):
            continue
        if block and (len(block) >= BLOCK or size + len(ws) > BLOCK_WORDS):
            yield block
            block, size = {}, 0
        block[r.item_id] = block.get(r.item_id, []) + ws
        size += len(ws)
    if block:
        yield block


def randomised_svd(rows: list[dict[int, float]], width: int, rank: int, spark=None, seed: int = 7) -> np.ndarray:
    """Right singular vectors (width x rank) of a sparse matrix. With a session the products with the matrix are computed in
    parts of its rows by the executors; what they return is width x rank numbers a part, of few parts."""
    rank = min(rank, len(rows), width)
    parts = [rows[k::4] for k in range(4) if rows[k::4]]

    def product(part: list[dict[int, float]], m: np.ndarray) -> np.ndarray:
        """A'A m of the part."""
        out = np.zeros((width, m.shape[1]), np.float32)
        for row in part:
            ids, values = np.fromiter(row, int, len(row)), np.fromiter(row.values(), np.float32, len(row))
            y = values @ m[ids]
            out[ids] += values[:, None] * y[None, :]
        return out

    def gram(m: np.ndarray) -> np.ndarray:
        if spark is None:
            return sum(product(p, m) for p in parts)
        shared = spark.sparkContext.broadcast(m)
        schema = "part binary"
        frame = spark.createDataFrame([(i,) for i in range(len(parts))], "i int").repartition(len(parts), "i")
        pieces = spark.sparkContext.broadcast(parts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_pydict({"part": pa.array([product(pieces.value[i], shared.value).tobytes()], pa.binary())})

        return sum(np.frombuffer(r.part, np.float32).reshape(width, -1) for r in frame.mapInArrow(run, schema).collect())

    m = np.random.default_rng(seed).standard_normal((width, min(width, rank + 16))).astype(np.float32)
    for _ in range(POWER):
        m = np.linalg.qr(gram(m))[0].astype(np.float32)
    # the small eigenproblem within the range found
    small = m.T @ gram(m)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    order = order[values[order] > 1e-6 * max(1e-12, float(values.max()))]
    return (m @ vectors[:, order]).astype(np.float32)


def longest_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of successive words that both have."""
    best, before = 0, {}
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    for w in a:
        now = {}
        for j in places.get(w, ()):
            now[j] = before.get(j - 1, 0) + 1
            if now[j] > best:
                best = now[j]
        before = now
    return best


def longest_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel counting."""
    masks: dict[str, int] = {}
    for j, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << j
    full, v = (1 << len(b)) - 1, (1 << len(b)) - 1
    for w in a:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return bin(~v & full).count("1")


def find_leaks(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, run, subsequence): corpus documents and the evaluation items near them: the largest cosine of
    their passages, their longest common run of words and the share of the item's words in the longest common subsequence
    of item and passage. Repeated ids count once; items and documents with null ids are left out."""
    spark = corpus.sparkSession
    rows = corpus.where("doc_id is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    schema = "doc_id long, item_id long, cosine double, run int, subsequence double"
    df = total = None
    found = []
    for asked in blocks_of(items):
        if df is None:
            df = written(passage_df(rows), "passage-df")
            total = df.where("w = ''").agg(F.sum("n")).first()[0] or 0
        if found:  # one plan a block
            found[-1] = written(found[-1], "leaks")
        known = spark.createDataFrame([(w,) for w in {w for ws in asked.values() for w in ws}], "w string")
        held = {r.w: r.n for r in df.join(known, "w").collect()}  # of the words of one block
        idf = {r: math.log((1 + total) / (1 + held.get(r, 0))) + 1e-3 for ws in asked.values() for r in ws}
        found.append(_block(rows, asked, idf, schema))
    out = spark.createDataFrame([], schema)
    for part in found:
        out = out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("run").alias("run"), F.max("subsequence").alias("subsequence"))


def _vector(ws: list[str], ids: dict[str, int], idf: dict[str, float]) -> dict[int, float]:
    return {ids[w]: (1 + math.log(n)) * idf[w] for w, n in Counter(ws).items() if w in ids}


def _block(rows: DataFrame, asked: dict[int, list[str]], idf: dict[str, float], schema: str) -> DataFrame:
    spark = rows.sparkSession
    ids = {w: k for k, w in enumerate(sorted({w for ws in asked.values() for w in ws if w in idf}))}
    passages, tallies, owner = [], [], []
    for item, ws in asked.items():
        for at in windows(len(ws)):
            if v := _vector(ws[at : at + WINDOW], ids, idf):
                passages.append(v)
                tallies.append({ids[w]: n for w, n in Counter(ws[at : at + WINDOW]).items()})
                owner.append(item)
    if not passages:
        return spark.createDataFrame([], schema)
    space = randomised_svd(passages, len(ids), max(LEAST_RANK, len(passages) // SHARE), spark)

    def project(v: dict[int, float]) -> np.ndarray:
        return np.fromiter(v.values(), np.float32, len(v)) @ space[np.fromiter(v, int, len(v))]

    latent = np.array([project(v) for v in passages])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    # weight of each word in each passage, a row a word: at most words x passages of a block
    table = np.zeros((len(ids), len(passages)), np.float32)
    times = np.zeros((len(ids), len(passages)), np.uint8)
    for j, (v, tally) in enumerate(zip(passages, tallies)):
        k, x = np.fromiter(v, int, len(v)), np.fromiter(v.values(), np.float32, len(v))
        table[k, j] = x / max(1e-9, float(np.linalg.norm(x)))
        times[k, j] = [tally[i] for i in k]
    weights = np.array([idf[w] for w in ids], np.float32)
    shared = spark.sparkContext.broadcast((ids, weights, space, latent, np.array(owner), asked, table, times))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights, space, latent, owner, asked, table, times = shared.value
        kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("run", pa.int32()), ("subsequence", pa.float64())])
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for text, doc in zip(*(batch.column(k).to_pylist() for k in range(2))):
                ws = words(text)
                if len(ws) < RUN:
                    continue
                best: dict[int, list] = {}
                for item, around, cosine in _near(ws, ids, weights, space, latent, owner, table, times):
                    b = best.setdefault(item, [0.0, 0, 0.0])
                    b[0] = max(b[0], cosine)
                    b[1] = max(b[1], longest_run(around, asked[item]))
                    b[2] = max(b[2], longest_subsequence(around, asked[item]) / len(asked[item]))
                for item, b in best.items():
                    for column, value in zip(out, (doc, item, *b)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(out, kinds)], schema=kinds)

    return rows.mapInArrow(search, schema)


#: Passages of a document that are compared at once.
AT_ONCE = 256


def _near(ws: list[str], ids: dict[str, int], weights: np.ndarray, space: np.ndarray, latent: np.ndarray, owner: np.ndarray, table: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, list[str], float]]:
    """(item, words, cosine) of a document's passages, with a run's length on either side so that a run is measured whole, and the items
    they are near."""
    every = np.array([ids.get(w, -1) for w in ws])
    starts = windows(len(ws))
    for first in range(0, len(starts), AT_ONCE):
        part = starts[first : first + AT_ONCE]
        begin, end = part[0], part[-1] + WINDOW
        inside = every[begin:end]
        known, place = np.unique(inside[inside >= 0], return_inverse=True)
        if not len(known):
            continue
        where = np.full(len(inside), -1)
        where[inside >= 0] = place
        counts = np.zeros((len(known), len(part)), np.float32)
        for j, at in enumerate(part):
            w = where[at - begin : at - begin + WINDOW]
            counts[:, j] = np.bincount(w[w >= 0], minlength=len(known))
        v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * weights[known][:, None]
        length = np.maximum(np.linalg.norm(v, axis=0), 1e-9)
        rows = table[known]
        # a passage's words that an item's passage has, as often as they come: no fewer than they have in common; that is counted next
        near, at_part = np.nonzero((rows.T @ v >= COSINE * length) | ((rows > 0).astype(np.float32).T @ counts >= RUN))
        if not len(near):
            continue
        many = np.minimum(counts[:, at_part], times[known][:, near]).sum(axis=0) >= RUN
        # against the whole vector's length: what the latent space doesn't hold counts as unlike
        z = space[known].T @ v
        cosines = np.einsum("ij,ji->i", latent[near], z[:, at_part]) / length[at_part]
        for i in np.nonzero((cosines >= COSINE) | many)[0]:
            at = part[at_part[i]]
            yield int(owner[near[i]]), ws[max(0, at - RUN) : at + WINDOW + RUN], float(cosines[i])
