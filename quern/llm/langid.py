"""Languages of documents and of the lines of mixed documents: multilingual mixture inference.

Each language has an n-gram model: character trigrams within words, mixed with the frequencies of whole words, trained on a
bounded sample of rows whose label names a language (about ``PER_LANGUAGE`` documents of each, the smallest hashes of doc_id, so
the same at every run; wrong labels among them only blur the counts). Every line of every document is scored under every
language. For each document expectation-maximisation then estimates in which proportions its lines come from a set of
languages; a set grows by the language that raises the likelihood most, as long as the rise exceeds ``PENALTY`` for the
language added, the penalised likelihood. Lines get the language of largest responsibility within the chosen set.

Null, empty and blank texts and texts without letters have no language and no row. Lines are split at LF; blank ones are
not counted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import keep

#: Bounds of the training sample and of the model, each for one language.
PER_LANGUAGE = 2_000
WORDS_KEPT = 4_000
GRAMS_KEPT = 20_000
#: Rise of the log-likelihood (nats) that a further language of a document must bring.
PENALTY = 14.0
ROUNDS = 25

_WORD = re.compile(r"[^\W\d_]+")
# ISO 639-2 codes of languages with a two-letter code.
ISO_639_2 = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "nld": "nl", "dut": "nl", "ita": "it",
    "pol": "pl", "swe": "sv", "dan": "da", "nor": "no", "fin": "fi", "ces": "cs", "cze": "cs", "rus": "ru", "tur": "tr", "ron": "ro", "rum": "ro",
}


def label_code(label: Column, codes: list[tuple[str, str]]) -> Column:
    """The language that a label names, in whatever way (case, blanks, three letters, region, English name); null if none."""
    text = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    first = F.regexp_extract(text, r"^([^\W\d_]+)", 1)
    names = {code: code for code, _ in codes} | {name.lower(): code for code, name in codes if name}
    names |= {three: two for three, two in ISO_639_2.items() if two in {c for c, _ in codes}}
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.when(first != "", F.try_element_at(table, first))


class Model:
    """Word and character n-gram likelihoods, one column a language."""

    def __init__(self, langs: list[str], words: dict[str, dict[str, int]], grams: dict[str, dict[str, int]]):
        self.langs = langs
        k = len(langs)
        self.words: dict[str, np.ndarray] = {}
        self.grams: dict[str, np.ndarray] = {}
        n_words = np.array([max(1, sum(words.get(x, {}).values())) for x in langs], float)
        for w in {w for x in langs for w in words.get(x, {})}:
            self.words[w] = np.array([words.get(x, {}).get(w, 0) for x in langs], float) / n_words
        contexts: dict[str, np.ndarray] = {}
        counts: dict[str, np.ndarray] = {}
        for j, x in enumerate(langs):
            for g, n in grams.get(x, {}).items():
                counts.setdefault(g, np.zeros(k))[j] += n
                contexts.setdefault(g[:2], np.zeros(k))[j] += n
        self.grams = {g: np.log((c + 0.05) / (contexts[g[:2]] + 0.05 * 40)) for g, c in counts.items()}
        self.unseen = {c: np.log(0.05 / (n + 0.05 * 40)) for c, n in contexts.items()}
        self.floor = np.full(k, math.log(1 / 40))
        self.cache: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        """Log-likelihoods of a word, of the best language at most 9 over any: no single word decides."""
        found = self.cache.get(w)
        if found is None:
            s = f"^{w}$"
            chars = self.floor * 0
            for i in range(len(s) - 2):
                g = self.grams.get(s[i : i + 3])
                if g is None:
                    g = self.unseen.get(s[i : i + 2], self.floor)
                chars = chars + g
            whole = self.words.get(w)
            found = np.logaddexp(chars + math.log(0.3), np.log(np.maximum(whole, 1e-30)) + math.log(0.7)) if whole is not None else chars + math.log(0.3)
            found = np.maximum(found - found.max(), -9.0)
            if len(w) < 64:  # what is remembered has a bound
                if len(self.cache) > 200_000:
                    self.cache.clear()
                self.cache[w] = found
        return found

    def line(self, text: str) -> tuple[int, np.ndarray]:
        ws = _WORD.findall(text.lower())
        total = np.zeros(len(self.langs))
        for w in ws:
            total += self.word(w)
        return len(ws), total


def mixture(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, responsibilities) of the languages, columns, for the lines, rows, by penalised likelihood."""

    def fit(members: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        part = scores[:, members]
        share = np.full(len(members), 1 / len(members))
        top = part.max(axis=1, keepdims=True)
        like = np.exp(part - top)
        for _ in range(ROUNDS):
            joint = like * share
            each = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
            new = each.mean(axis=0)
            if np.abs(new - share).max() < 1e-6:
                break
            share = new
        joint = like * share
        total = joint.sum(axis=1, keepdims=True)
        return float((np.log(np.maximum(total, 1e-300)) + top).sum()), share, joint / np.maximum(total, 1e-300)

    k = scores.shape[1]
    members = [int(scores.sum(axis=0).argmax())]
    best, share, each = fit(members)
    # what a further language could bring at most is what each line gains by it
    while len(members) < k and scores.shape[0] > 1:
        now = scores[:, members].max(axis=1)
        gains = [(float(np.maximum(scores[:, j] - now, 0).sum()), j) for j in range(k) if j not in members]
        gain, j = max(gains)
        if gain <= PENALTY:
            break
        value, new_share, new_each = fit([*members, j])
        if value - best <= PENALTY:
            break
        members, best, share, each = [*members, j], value, new_share, new_each
    proportions, responsibilities = np.zeros(k), np.zeros((scores.shape[0], k))
    proportions[members] = share
    responsibilities[:, members] = each
    return proportions, responsibilities


def train(documents: DataFrame, codes: list[tuple[str, str]]) -> Model:
    """Trains on the bounded sample; what comes to the driver is the model: at most WORDS_KEPT words and GRAMS_KEPT
    trigrams of each language."""
    langs = sorted({code for code, _ in codes})
    labelled = documents.select("doc_id", "text", label_code(F.col("lang"), codes).alias("code")).where("code is not null and text <> ''")
    chosen = labelled.withColumn("turn", F.xxhash64("doc_id"))
    cut = _cut(chosen)
    sample = keep(chosen.join(F.broadcast(cut), "code").where("turn <= cut").select("code", "text"))
    word = sample.select("code", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("w"))
    counts = word.groupBy("code", "w").agg(F.count("*").alias("n"))
    counts = keep(counts)
    gram = counts.select("code", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.lit("^"), F.col("w"), F.lit("$")).substr(i, F.lit(3)))).alias("g"))
    gram = gram.groupBy("code", "g").agg(F.sum("n").alias("n"))
    return Model(langs, _top(counts, "w", WORDS_KEPT), _top(gram, "g", GRAMS_KEPT))


def _cut(rows: DataFrame) -> DataFrame:
    """For each language the hash under which about PER_LANGUAGE rows lie; one row a language."""
    n = rows.groupBy("code").agg(F.count("*").alias("n"))
    span = F.lit(2.0**64)
    share = F.least(F.lit(1.0), F.lit(float(PER_LANGUAGE)) / F.col("n"))
    return n.select("code", F.when(F.col("n") <= PER_LANGUAGE, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + share * span).cast("long")).alias("cut"))


def _top(counts: DataFrame, key: str, most: int) -> dict[str, dict[str, int]]:
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("code").orderBy(F.col("n").desc(), F.col(key)))
    out: dict[str, dict[str, int]] = {}
    for r in counts.where("n > 1").withColumn("turn", turn).where(F.col("turn") <= most).collect():
        out.setdefault(r.code, {})[r[key]] = r.n
    return out


def assign_languages(documents: DataFrame, codes: list[tuple[str, str]], model: Model | None = None) -> DataFrame:
    """(doc_id, line_no, lang, confidence, share, label): line_no 0 is the document with the language most of its words are
    in; documents whose lines aren't all in one language have every line besides. ``share`` is the language's proportion,
    ``label`` what the row's own label names. Of repeated rows of a document one counts, the largest text."""
    model = model or train(documents, codes)
    shared = documents.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams, model.unseen, model.floor))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.langs, own.words, own.grams, own.unseen, own.floor = shared.value
        own.cache = {}
        kinds = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("share", pa.float64()), ("label", pa.string())])
        for batch in batches:
            rows: list[list] = [[] for _ in kinds]
            for doc, text, code in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for row in document_rows(own, text or ""):
                    for column, value in zip(rows, (doc, *row, code)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(rows, kinds)], schema=kinds)

    rows = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), label_code(F.col("lang"), codes).alias("code"))
    return _largest(rows).mapInArrow(label, "doc_id long, line_no int, lang string, confidence double, share double, label string")


def _largest(rows: DataFrame) -> DataFrame:
    """One row of each document: the one with the largest text, of equally large ones the smallest, then the smallest label. Only if
    documents are repeated at all, which their ids tell, texts are moved."""
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    by = Window.partitionBy("doc_id").orderBy(F.length("text").desc(), F.col("text"), F.col("code").asc_nulls_last())
    return rows.withColumn("turn", F.row_number().over(by)).where("turn = 1").drop("turn")


def document_rows(model: Model, text: str) -> list[tuple[int, str, float, float]]:
    """(line_no, language, confidence, share) of a document and, if it is mixed, of its lines."""
    lines = [line for line in text.split("\n") if line.strip()]
    scored = [model.line(line) for line in lines]
    spoken = [i for i, (n, _) in enumerate(scored) if n]
    if not spoken:
        return []
    scores = np.array([scored[i][1] for i in spoken])
    shares, each = mixture(scores)
    weights = np.array([scored[i][0] for i in spoken], float)
    picks = each.argmax(axis=1)
    words = np.bincount(picks, weights=weights, minlength=len(model.langs))
    main = int(words.argmax())
    out = [(0, model.langs[main], float((each[:, main] * weights).sum() / weights.sum()), float(words[main] / words.sum()))]
    if len(set(picks.tolist())) > 1:
        place = {i: k for k, i in enumerate(spoken)}
        last = picks[0]
        for i in range(len(lines)):
            if i in place:  # a line without letters goes with the line before it
                last = picks[place[i]]
                sure = float(each[place[i], last])
            else:
                sure = 0.0
            out.append((i + 1, model.langs[int(last)], sure, float(words[int(last)] / words.sum())))
    return out


def mislabelled(assigned: DataFrame) -> DataFrame:
    """(doc_id, line_no, lang): documents whose label is missing, says nothing or names another language, and the lines of
    mixed documents."""
    return assigned.where("line_no > 0 or label is null or label <> lang").select("doc_id", "line_no", "lang")
