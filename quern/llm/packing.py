"""Filling containers of fixed capacity: pattern packing by non-negative least squares.

Only the histogram of lengths reaches the driver, at most ``capacity`` numbers however many documents there are. There
lengths are rounded up to ``CLASSES`` classes; patterns of few lengths that fill a container are enumerated; non-negative
least squares fits how often each is to be repeated so that together they use up the histogram; the counts are rounded
down, and what is left over goes into the patterns' gaps and into new containers by best fit, longest first, again for all
documents of a length at once. The plan is a list of (length, how many, container) segments whose number depends on the
number of lengths, not of documents; every document finds its place by its number among the documents of its length. That
numbering is done in ``spread`` buckets with a prefix sum of their counts, so a length that a third of all documents have is
no single task.

A document longer than the capacity is cut into full containers of its own and a rest, which is packed like a document; a
document that fits is never cut. Null and empty texts have no tokens and are left out. Of rows with the same id all count
once, with the largest size.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import keep

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of this public byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CLASSES = 128
ROUNDS = 400


def token_sizes(documents: DataFrame, path: str = TOKENIZER, pattern: str = SPLIT) -> DataFrame:
    """(doc_id, tokens) of the documents with text. The vocabulary is read once, by the driver."""
    with open(path, "rb") as lines:
        raw = lines.read()
    shared = documents.sparkSession.sparkContext.broadcast(raw)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines()) if a}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    rows = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def patterns(classes: int = CLASSES) -> list[dict[int, int]]:
    """Ways to fill ``classes`` units: up to three single lengths, or up to two lengths with repeats."""
    found: set[tuple[tuple[int, int], ...]] = set()
    for a in range(1, classes + 1):
        for k in range(1, classes // a + 1):
            rest = classes - a * k
            if not rest:
                found.add(((a, k),))
            for b in range(1, min(a - 1, rest) + 1):
                if rest % b == 0:
                    found.add(((b, rest // b), (a, k)))
    for a in range(1, classes // 3):
        for b in range(a + 1, (classes - a) // 2 + 1):
            if b < (c := classes - a - b):
                found.add(((a, 1), (b, 1), (c, 1)))
    return [dict(p) for p in sorted(found)]


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by accelerated projected gradient."""
    gram, target = a.T @ a, a.T @ b
    v = np.ones(len(gram))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = gram @ v
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1.0 / max(float(v @ gram @ v) * 1.01, 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (gram @ y - target), 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """({length: [(first document, first container, documents in each container)]}, number of containers).

    The documents of a length, numbered from 0, fall into the segment they lie in; document i of a segment that begins at s goes to
    container first + (i - s) // each."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    places: dict[int, list[tuple[int, int, int]]] = {n: [] for n in left}
    containers = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> (first container, how many)

    def put(length: int, first: int, times: int, each: int) -> None:
        places[length].append((used[length], first, each))
        used[length] += times * each
        left[length] -= times * each

    classes = min(CLASSES, capacity)
    of = lambda length: -(-length * classes // capacity)
    by_class: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        by_class.setdefault(of(n), []).append(n)
    ways = [p for p in patterns(classes) if all(c in by_class for c in p)]
    if ways:
        a = np.zeros((classes, len(ways)))
        for j, p in enumerate(ways):
            for c, k in p.items():
                a[c - 1, j] = k
        have = np.array([sum(left[n] for n in by_class.get(c, ())) for c in range(1, classes + 1)], float)
        weight = np.arange(1, classes + 1) / classes  # a token left over weighs alike whatever its document's length
        fit = nonnegative_least_squares(a * weight[:, None], have * weight)
        for j in np.argsort(-fit):
            wanted = int(fit[j])
            while wanted > 0:
                # the longest documents left of each class; a segment ends where one of them is used up
                slots = []
                for c, k in ways[j].items():
                    here = by_class[c]
                    while here and left[here[0]] < k and sum(left[n] for n in here) >= k and len(here) > 1 and left[here[0]] == 0:
                        here.pop(0)
                    pick = next((n for n in here if left[n] >= k), None)
                    if pick is None:
                        break
                    slots.append((pick, k))
                if len(slots) < len(ways[j]):
                    break
                times = min(wanted, *(left[n] // k for n, k in slots))
                for n, k in slots:
                    put(n, containers, times, k)
                gaps.setdefault(capacity - sum(n * k for n, k in slots), []).append((containers, times))
                containers += times
                wanted -= times
    # the rest by best fit, longest first
    rooms = sorted(g for g in gaps if g > 0)
    for n in sorted(left, reverse=True):
        while left[n] > 0:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                times = left[n] // each
                if times:
                    put(n, containers, times, each)
                else:
                    each, times = left[n], 1
                    put(n, containers, 1, each)
                first, room = containers, capacity - n * each
                containers += times
            else:
                room = rooms[at]
                first, times = gaps[room].pop()
                if not gaps[room]:
                    rooms.pop(at)
                if times > left[n]:  # only some of these containers are needed
                    keep_from = first + left[n]
                    gaps[room].append((keep_from, times - left[n]))
                    if len(gaps[room]) == 1:
                        insort(rooms, room)
                    times = left[n]
                each = min(room // n, max(1, left[n] // times))
                put(n, first, times, each)
                room -= n * each
            if room > 0:
                gaps.setdefault(room, []).append((first, times))
                if len(gaps[room]) == 1 and room not in rooms:
                    insort(rooms, room)
    return places, containers


def pack(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, container, doc_id, part, tokens): containers are numbered from 1 within a capacity, parts of a document from
    0. Capacities that are null or below 1 are left out."""
    spark = sizes.sparkSession
    limits = {r.capacity_id: r.most for r in capacities.where("capacity_id is not null and max_tokens > 0").groupBy("capacity_id").agg(F.max("max_tokens").alias("most")).collect()}  # the containers asked for
    schema = "capacity_id int, container long, doc_id long, part int, tokens int"
    if not limits:
        return spark.createDataFrame([], schema)
    sizes = keep(sizes.where("doc_id is not null and tokens > 0").select("doc_id", "tokens"))
    spread = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int")
    each = sizes.select("doc_id", "tokens", F.explode(F.create_map(*[F.lit(int(x)) for pair in limits.items() for x in pair])).alias("capacity_id", "most"))
    rest = each.select("capacity_id", "doc_id", (F.col("tokens") % F.col("most")).cast("int").alias("length"), F.floor(F.col("tokens") / F.col("most")).cast("int").alias("part"), bucket.alias("bucket"))
    items = rest.where("length > 0")
    counts = keep(items.groupBy("capacity_id", "length", "bucket").agg(F.count("*").alias("n")))
    histograms: dict[int, dict[int, int]] = {k: {} for k in limits}
    for r in counts.groupBy("capacity_id", "length").agg(F.sum("n").alias("n")).collect():  # at most the sum of all capacities
        histograms[r.capacity_id][r.length] = r.n
    plans = {k: plan(h, limits[k]) for k, h in histograms.items()}
    shared = spark.sparkContext.broadcast({k: p for k, (p, _) in plans.items()})
    before = F.sum("n").over(Window.partitionBy("capacity_id", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("capacity_id", "length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    turn = F.row_number().over(Window.partitionBy("capacity_id", "length", "bucket").orderBy("doc_id"))
    numbered = items.withColumn("turn", turn).join(offsets, ["capacity_id", "length", "bucket"]).select("capacity_id", "length", "doc_id", "part", (F.col("before") + F.col("turn") - 1).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[tuple[int, int], list[int]] = {}
        kinds = pa.schema([("capacity_id", pa.int32()), ("container", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("tokens", pa.int32())])
        for batch in batches:
            found = []
            for capacity, length, number in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4))):
                segments = shared.value[capacity][length]
                own = starts.get((capacity, length))
                if own is None:
                    own = starts[capacity, length] = [s[0] for s in segments]
                start, first, many = segments[bisect_left(own, number + 1) - 1]
                found.append(first + (number - start) // many + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(2), batch.column(3), batch.column(1)], schema=kinds)

    placed = numbered.mapInArrow(place, schema)
    # full containers of documents that exceed the capacity come behind the planned ones, numbered in the same way
    after = F.create_map(*[F.lit(int(x)) for k, (_, n) in plans.items() for x in (k, n)])
    whole = rest.where("part > 0")
    wholes = whole.groupBy("capacity_id", "bucket").agg(F.sum("part").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("capacity_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    running = F.sum("part").over(Window.partitionBy("capacity_id", "bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    full = (
        whole.withColumn("running", F.coalesce(running, F.lit(0)))
        .join(F.broadcast(wholes.select("capacity_id", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))), ["capacity_id", "bucket"])
        .select("capacity_id", "doc_id", "running", "ahead", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("piece"))
        .select(
            "capacity_id",
            (F.element_at(after, F.col("capacity_id")) + F.col("ahead") + F.col("running") + F.col("piece") + 1).cast("long").alias("container"),
            "doc_id",
            F.col("piece").alias("part"),
            F.element_at(F.create_map(*[F.lit(int(x)) for pair in limits.items() for x in pair]), F.col("capacity_id")).alias("tokens"),
        )
    )
    return placed.unionByName(full)
