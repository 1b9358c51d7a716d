"""Blocks of queries against splits of documents, in arrays.

A block of queries is sent to the workers with its words and word pairs as numbers; each worker meets it with the documents that
stream by, some hundred at a time. Words that many queries share with many documents are one matrix product, the others are
expanded to (document, query) pairs and added up by ``numpy.bincount``. So no pair of a query and a document is ever moved, sorted
or spilled: what leaves a worker are results, or counts and the best few of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and words of a block, queries and documents that are scored at once, and words of the matrix product: those that at least
#: DENSE of the block's pairs would share.
BLOCK_QUERIES, BLOCK_WORDS, QUERIES, DOCS, DENSE, MOST_DENSE = 8192, 2_000_000, 1024, 512, 0.005, 512
#: Bins of the unigram scores, which are from 0 to 1.
BINS = 1024
EXPANDED = 4_000_000


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The rows (query_id, terms) that have words, in blocks that fit a worker."""
    queries = queries.select("query_id", "terms").where("query_id is not null and size(terms) > 0")
    n, words = queries.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(1, -(-n // BLOCK_QUERIES), -(-(words or 0) // BLOCK_WORDS))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [queries]


def _expand(ptr: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): for each row's key the places that ``ptr`` gives it."""
    n = ptr[keys + 1] - ptr[keys]
    row = np.repeat(np.arange(len(keys)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[keys], n)


def _weight(tf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((df > 0) & (df != n), (1 + np.log10(tf)) * np.log10(n / df), 0.0)


class _Part:
    """Some queries by their words and pairs: who asks for each, and with what weight."""

    def __init__(self, asked: Asked, low: int, high: int) -> None:
        self.low, self.n = low, high - low
        q, t, tf = (x[slice(*np.searchsorted(asked.uni[0], [low, high]))] for x in asked.uni)
        self.q, self.t, self.starts = q - low, t, np.searchsorted(q - low, np.arange(high - low + 1))
        self.by_word = self._by(self.q, t, asked.wq(t, tf, asked.df) / asked.length[q], len(asked.words))
        pq, p, ptf = (x[slice(*np.searchsorted(asked.bi[0], [low, high]))] for x in asked.bi)
        w = asked.wq(p, ptf, asked.df2) / asked.length2[pq]
        self.by_pair = self._by(pq - low, p, np.stack([w, ptf.astype(float)], 1), len(asked.pairs))
        share = np.diff(self.by_word[0]) / max(1, self.n) * (asked.df / max(1, asked.n))
        dense = np.flatnonzero(share > DENSE)
        self.dense = dense[np.argsort(-share[dense], kind="stable")][:MOST_DENSE]
        self.column = np.full(len(asked.words), -1)
        self.column[self.dense] = np.arange(len(self.dense))
        self.matrix = np.zeros((len(self.dense), self.n))
        row, at = _expand(self.by_word[0], self.dense)
        self.matrix[row, self.by_word[1][at]] = self.by_word[2][at]

    @staticmethod
    def _by(q: np.ndarray, key: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        return np.searchsorted(key[order], np.arange(n + 1)), q[order], w[order]


class Asked:
    """A block of queries as numbers, from a table (query_id, terms); with (term, df), (bigram, df) and n also their weights."""

    def __init__(self, table: pa.Table, lexicon: pa.Table | None = None, lexicon2: pa.Table | None = None, n: int = 0) -> None:
        self.n = n
        self.ids, query = np.unique(table.column(0).to_numpy(), return_inverse=True)
        lists = table.column(1).combine_chunks()
        row = pc.list_parent_indices(lists).to_numpy()
        encoded = pc.dictionary_encode(pc.list_flatten(lists))
        encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
        self.words, t = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        v, q = len(self.words), query[row].astype(np.int64)
        key, tf = np.unique(q * v + t, return_counts=True)
        self.uni = key // v, key % v, tf
        near = np.flatnonzero(row[1:] == row[:-1])
        self.pairs, p = np.unique(t[near] * v + t[near + 1], return_inverse=True)
        key, tf = np.unique(q[near] * max(1, len(self.pairs)) + p, return_counts=True)
        self.bi = key // max(1, len(self.pairs)), key % max(1, len(self.pairs)), tf
        self.df, self.df2 = np.zeros(v), np.zeros(len(self.pairs))
        if lexicon is not None:
            self.df = self._dfs(self.words, lexicon)
        if lexicon2 is not None and len(self.pairs):
            first, second = (self.words.take(pa.array(x)).cast(pa.string()) for x in (self.pairs // v, self.pairs % v))
            self.df2 = self._dfs(pc.binary_join_element_wise(first, second, " "), lexicon2)
        self.length = self._lengths(self.uni, self.df)
        self.length2 = self._lengths(self.bi, self.df2)
        self.parts = [_Part(self, k, min(k + QUERIES, len(self.ids))) for k in range(0, len(self.ids), QUERIES)]

    @staticmethod
    def _dfs(keys: pa.Array, lexicon: pa.Table) -> np.ndarray:
        at = pc.index_in(keys.cast(pa.string()), value_set=lexicon.column(0).combine_chunks().cast(pa.string()))
        return pc.fill_null(lexicon.column(1).combine_chunks().take(at), 0).to_numpy(zero_copy_only=False).astype(float)

    def wq(self, key: np.ndarray, tf: np.ndarray, df: np.ndarray) -> np.ndarray:
        return _weight(tf, df[key], self.n)

    def _lengths(self, rows: tuple, df: np.ndarray) -> np.ndarray:
        squares = np.bincount(rows[0], self.wq(rows[1], rows[2], df) ** 2, minlength=len(self.ids))
        return np.sqrt(np.where(squares > 0, squares, 1.0))


class _Docs:
    """Documents by the words that are asked for: (doc, word, tf) and (doc, pair, tf) in the order of documents."""

    def __init__(self, asked: Asked, batch: pa.RecordBatch) -> None:
        names, v = batch.schema.names, len(asked.words)
        self.ids = batch.column(0).to_numpy(zero_copy_only=False)
        n = len(self.ids)
        one = lambda k: np.where((x := pc.fill_null(batch.column(names.index(k)), 1.0).to_numpy(zero_copy_only=False)) == 0, 1.0, x) if k in names else np.ones(n)
        self.norm, self.norm2 = one("norm"), one("norm2")
        lists = batch.column(names.index("terms"))
        doc = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        t = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=asked.words), -1).to_numpy().astype(np.int64)
        known = np.flatnonzero(t >= 0)
        if "positions" in names:  # postings: a word of a document once
            spots = pc.list_flatten(batch.column(names.index("positions")))
            at, pos = pc.list_parent_indices(spots).to_numpy(), pc.list_flatten(spots).to_numpy().astype(np.int64)
            key, tf = doc[known] * v + t[known], pc.list_flatten(batch.column(names.index("tfw"))).to_numpy()[known]
            order = np.argsort(key)
            key, tf = key[order], tf[order]
            order = np.lexsort((pos, doc[at]))
            doc, t, pos = doc[at][order], t[at][order], pos[order]
            at = t >= 0
            doc, t, pos = doc[at], t[at], pos[at]
        else:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            pos = np.arange(len(doc)) - np.concatenate([[0], ends])[doc]
            doc, t, pos = doc[known], t[known], pos[known]
            key, tf = np.unique(doc * v + t, return_counts=True)
        self.doc, self.t, self.tf = key // v, key % v, tf
        near = np.flatnonzero((doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1))
        pair, doc = t[near] * v + t[near + 1], doc[near]
        p = np.minimum(np.searchsorted(asked.pairs, pair), max(0, len(asked.pairs) - 1))
        same = asked.pairs[p] == pair if len(asked.pairs) else np.zeros(len(pair), bool)
        key, tf = np.unique(doc[same] * max(1, len(asked.pairs)) + p[same], return_counts=True)
        self.pair_doc, self.p, self.pair_tf = key // max(1, len(asked.pairs)), key % max(1, len(asked.pairs)), tf
        self.w = _weight(self.tf, asked.df[self.t], asked.n) / self.norm[self.doc]
        self.pair_w = _weight(self.pair_tf, asked.df2[self.p], asked.n) / self.norm2[self.pair_doc]

    def slices(self) -> Iterator[_Slice]:
        for low in range(0, len(self.ids), DOCS):
            yield _Slice(self, low, min(low + DOCS, len(self.ids)))


class _Slice:
    def __init__(self, docs: _Docs, low: int, high: int) -> None:
        self.ids, self.n = docs.ids[low:high], high - low
        at = slice(*np.searchsorted(docs.doc, [low, high]))
        self.doc, self.t, self.w = docs.doc[at] - low, docs.t[at], docs.w[at]
        at = slice(*np.searchsorted(docs.pair_doc, [low, high]))
        self.pair_doc, self.p, self.pair_tf, self.pair_w = docs.pair_doc[at] - low, docs.p[at], docs.pair_tf[at], docs.pair_w[at]

    def unigram(self, part: _Part) -> np.ndarray:
        """Cosines, (documents, queries)."""
        column = part.column[self.t]
        dense = column >= 0
        weights = np.zeros((self.n, len(part.dense)))
        weights[self.doc[dense], column[dense]] = self.w[dense]
        found = weights @ part.matrix
        doc, t, w = self.doc[~dense], self.t[~dense], self.w[~dense]
        for at in self._steps(part.by_word[0], t):
            row, place = _expand(part.by_word[0], t[at])
            found += np.bincount(doc[at][row] * part.n + part.by_word[1][place], w[at][row] * part.by_word[2][place], minlength=found.size).reshape(found.shape)
        return found

    @staticmethod
    def _steps(ptr: np.ndarray, keys: np.ndarray) -> Iterator[slice]:
        step = np.cumsum(ptr[keys + 1] - ptr[keys]) // EXPANDED
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(keys)]
        return (slice(a, b) for a, b in zip(cuts, cuts[1:]))

    def pairs(self, part: _Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in (documents, queries), hits, cosine) of those that share a word pair."""
        found = np.zeros((0,), np.int64), np.zeros(0), np.zeros(0)
        for at in self._steps(part.by_pair[0], self.p):
            row, place = _expand(part.by_pair[0], self.p[at])
            key, back = np.unique(self.pair_doc[at][row] * part.n + part.by_pair[1][place], return_inverse=True)
            w = part.by_pair[2][place]
            found = tuple(map(lambda *x: np.concatenate(x), found, (key, np.bincount(back, self.pair_tf[at][row] * w[:, 1], minlength=len(key)), np.bincount(back, self.pair_w[at][row] * w[:, 0], minlength=len(key)))))
        key, back = np.unique(found[0], return_inverse=True)  # a pair may lie in two steps
        return key, np.bincount(back, found[1], minlength=len(key)).astype(np.int64), np.bincount(back, found[2], minlength=len(key))

    def any_word(self, part: _Part) -> np.ndarray:
        found = np.zeros(self.n * part.n, bool)
        for at in self._steps(part.by_word[0], self.t):
            row, place = _expand(part.by_word[0], self.t[at])
            found[self.doc[at][row] * part.n + part.by_word[1][place]] = True
        return np.flatnonzero(found)

    def all_words(self, part: _Part) -> np.ndarray:
        """Places of the documents with all words of the query: those with its rarest word here are looked at."""
        if not len(part.q) or not len(self.t):
            return np.zeros(0, np.int64)
        v = len(part.column)
        order = np.argsort(self.t, kind="stable")
        ptr = np.searchsorted(self.t[order], np.arange(v + 1))
        rank = np.diff(ptr)[part.t] * len(part.t) + np.arange(len(part.t))
        least = np.minimum.reduceat(rank, part.starts[:-1])
        query = np.flatnonzero(least >= len(part.t))
        row, place = _expand(ptr, part.t[least[query] % len(part.t)])
        query, doc = query[row], self.doc[order][place]
        keys, found = self.doc * v + self.t, []
        for at in self._steps(part.starts, query):
            row, place = _expand(part.starts, query[at])
            key = doc[at][row] * v + part.t[place]
            there = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            whole = np.bincount(row, ~there, minlength=len(query[at])) == 0
            found.append(doc[at][whole] * part.n + query[at][whole])
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def over(docs: DataFrame, asked: list, schema: str, work: Callable[[Asked], tuple[Callable, Callable]]) -> DataFrame:
    """Runs ``work`` on every document of docs (doc_id, terms, ..) for a block of queries, the arguments of ``Asked``. It gives a function
    of a slice and a part, and one that is called at the end of a split; both give columns of the schema."""
    sent = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Asked(*sent.value)
        each, last = work(block)
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 8 * DOCS):
                for part_docs in _Docs(block, batch.slice(at, 8 * DOCS)).slices():
                    for k, part in enumerate(block.parts):
                        if (found := each(part_docs, part, k)) is not None and len(found[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)
        if (found := last()) is not None and len(found[0]):
            whole = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in found], names=names)
            for k in range(0, whole.num_rows, 50_000):
                yield whole.slice(k, 50_000)

    return docs.mapInArrow(run, schema)


def all_words(block: Asked) -> tuple[Callable, Callable]:
    def each(docs: _Slice, part: _Part, k: int) -> tuple:
        at = docs.all_words(part)
        return block.ids[part.low + at % part.n], docs.ids[at // part.n]

    return each, lambda: None


def any_word(block: Asked) -> tuple[Callable, Callable]:
    def each(docs: _Slice, part: _Part, k: int) -> tuple:
        at = docs.any_word(part)
        return block.ids[part.low + at % part.n], docs.ids[at // part.n]

    return each, lambda: None


def word_pairs(block: Asked) -> tuple[Callable, Callable]:
    def each(docs: _Slice, part: _Part, k: int) -> tuple:
        at, hits, _ = docs.pairs(part)
        return block.ids[part.low + at % part.n], docs.ids[at // part.n], hits

    return each, lambda: None


def _scores(docs: _Slice, part: _Part) -> tuple:
    """Flat arrays (documents x queries): unigram cosine; places, hits and cosines of shared pairs; places of documents with all words."""
    return docs.unigram(part).ravel(), *docs.pairs(part), docs.all_words(part)


def best(alpha: float, beta: float, boost: float, k: int) -> Callable[[Asked], tuple[Callable, Callable]]:
    """Of each split the best k of each query in each tier, and how many the tiers hold: (query_id, tier, doc_id, score, n). Tier 0 has the
    documents with a phrase, 1 also those with all words, 2 all with a score; 3 counts those with a unigram score."""

    def work(block: Asked) -> tuple[Callable, Callable]:
        counts = np.zeros((4, len(block.ids)), np.int64)
        least = np.full((3, len(block.ids)), -1, np.int64)  # the k-th best so far
        kept = [(np.zeros(0, np.int64),) * 3 for _ in range(3)]

        def each(docs: _Slice, part: _Part, _: int) -> None:
            uni, at, hits, bi, every = _scores(docs, part)
            phrase = (uni[at] > 0) & (hits > 0)
            score = alpha * uni
            score[at] += beta * bi + np.where(phrase, boost * hits, 0.0)
            rounded = np.floor(score * 1e6 + 0.5).astype(np.int64)
            scored = np.flatnonzero((uni > 0) | (score > 0))
            own = slice(part.low, part.low + part.n)
            counts[3, own] += np.bincount(np.flatnonzero(uni > 0) % part.n, minlength=part.n)
            for tier, places in enumerate((at[phrase], np.union1d(at[phrase], every), scored)):
                q = places % part.n
                counts[tier, own] += np.bincount(q, minlength=part.n)
                r = rounded[places]
                good = r >= least[tier, own][q]
                if not good.any():
                    continue
                q, r, d = (np.concatenate([a, b]) for a, b in zip(kept[tier], (q[good] + part.low, r[good], docs.ids[places[good] // part.n])))
                order = np.lexsort((d, -r, q))
                q, r, d = q[order], r[order], d[order]
                turn = np.arange(len(q)) - np.searchsorted(q, q)
                full = turn == k - 1
                least[tier, q[full]] = r[full]
                kept[tier] = q[turn < k], r[turn < k], d[turn < k]

        def last() -> tuple:
            rows = [(block.ids[q], np.full(len(q), tier, np.int32), pa.array(d), r / 1e6, pa.nulls(len(q), pa.int64())) for tier, (q, r, d) in enumerate(kept)]
            for tier in range(4):
                q = np.flatnonzero(counts[tier])
                rows.append((block.ids[q], np.full(len(q), tier, np.int32), pa.nulls(len(q), pa.int64()), np.zeros(len(q)), pa.array(counts[tier, q])))
            return tuple(pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in column]) for column in zip(*rows))

        return each, last

    return work


def bins(limits: tuple[int | None, int | None]) -> Callable[[Asked], tuple[Callable, Callable]]:
    """Of each split how many documents of a query have at least the unigram scores of some bins: (query_id, kind, bin, n), kind 0 all with
    a score, 1 those with all words, at most some 64 bins each; kind 2 counts the documents with all words, 3 those with a unigram score."""

    def work(block: Asked) -> tuple[Callable, Callable]:
        found = [None if x is None else np.zeros((len(block.ids), BINS), np.int32) for x in limits]
        counts = np.zeros((2, len(block.ids)), np.int64)

        def each(docs: _Slice, part: _Part, _: int) -> None:
            uni, every = docs.unigram(part).ravel(), docs.all_words(part)
            own = slice(part.low, part.low + part.n)
            some = np.flatnonzero(uni > 0)
            counts[0, own] += np.bincount(every % part.n, minlength=part.n)
            counts[1, own] += np.bincount(some % part.n, minlength=part.n)
            for to, places in zip(found, (some, every)):
                if to is not None:
                    bin = np.minimum(uni[places] * BINS, BINS - 1).astype(np.int64)
                    to[own] += np.bincount(places % part.n * BINS + bin, minlength=part.n * BINS).reshape(part.n, BINS).astype(np.int32)

        def last() -> tuple:
            rows = []
            for kind, (to, limit) in enumerate(zip(found, limits)):
                for low in range(0, len(block.ids) if to is not None else 0, QUERIES):
                    sums = np.cumsum(to[low : low + QUERIES, ::-1], 1, dtype=np.int64)
                    before = np.pad(sums[:, :-1], ((0, 0), (1, 0)))
                    step = max(1, limit // 64)
                    q, b = np.nonzero((sums // step > before // step) & (before < limit))
                    upto = sums[q, b] // step * step
                    n = upto - np.where(np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool), 0, np.concatenate([[0], upto[:-1]]) if len(q) else 0)
                    rows.append((block.ids[low + q], np.full(len(q), kind, np.int32), (BINS - 1 - b).astype(np.int32), n))
            for kind in (0, 1):
                q = np.flatnonzero(counts[kind])
                rows.append((block.ids[q], np.full(len(q), kind + 2, np.int32), np.zeros(len(q), np.int32), counts[kind, q]))
            return tuple(np.concatenate(column) for column in zip(*rows))

        return each, last

    return work


def rows_from(lowest: pa.Table) -> Callable[[Asked], tuple[Callable, Callable]]:
    """(query_id, doc_id, unigram, bigram, hits, all_terms) of the documents from the bins that (query_id, low, low_all) names."""

    def work(block: Asked) -> tuple[Callable, Callable]:
        low = np.zeros((2, len(block.ids)))
        at = np.searchsorted(block.ids, lowest.column(0).to_numpy())
        for k in (0, 1):
            low[k, at] = lowest.column(k + 1).to_numpy() / BINS - 1e-9  # the last digits of a score may differ

        def each(docs: _Slice, part: _Part, _: int) -> tuple:
            uni, at, hits, bi, every = _scores(docs, part)
            own = slice(part.low, part.low + part.n)
            pair, with_all = np.zeros((2, len(uni))), np.zeros(len(uni), bool)
            pair[0, at], pair[1, at], with_all[every] = bi, hits, True
            shape = docs.n, part.n
            keep = ((uni > 0) | (pair[0] > 0)).reshape(shape) & (uni.reshape(shape) >= low[0, own])
            keep |= with_all.reshape(shape) & (uni.reshape(shape) >= low[1, own])
            d, q = np.nonzero(keep)
            at = d * part.n + q
            return block.ids[part.low + q], docs.ids[d], uni[at], pair[0, at], pair[1, at].astype(np.int64), with_all[at].astype(np.int32)

        return each, lambda: None

    return work
