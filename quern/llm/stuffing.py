"""Keyword-stuffed and link-list pages: block-wise compression ratio against what prose of the same length and language
gives, confirmed by sentence punctuation.

``chunks`` measures one page in plain Python; ``flag_stuffed`` sets the measures against the whole corpus.

A body is cut at block borders into chunks of about ``CHUNK`` characters. The corpus gives, for each language and each
doubling of length, the median and the quartiles of the ratio and the median of sentence ends per word. A chunk is
extremely redundant if its ratio lies more than ``SPREADS`` quartile ranges under the median while it has less than half
of the usual sentence ends, or twice as far whatever its punctuation. Lists of links and names that differ don't compress
well; they are told by having neither sentence ends nor function words. A page is stuffed if more than half of the words
of its body, the top heading aside, are in such chunks and lists.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 700
SPREADS = 3.0
#: Chunks under this length say too little by their ratio.
LEAST = 160

_WORD = re.compile(r"[^\W_]+")
_ENDS = re.compile(r"[.!?…](?=[\s\"'»”)]|$)")

# Words that tell the language of a chunk well enough to choose its baseline.
MARKERS = {
    "en": "the of and to in for is that this with from every their when until",
    "fr": "le les une des du et est pas pour dans sur chaque leur notre que",
    "de": "der die das und ist nicht zu mit von diese jede unsere ihre wenn dass",
    "es": "el los las una por con cada este aquel nuestro desde cuando aunque hasta y",
    "pt": "o os uma do da em com para não esse aquele nosso foi quando cada",
    "nl": "het een van dat niet op te voor deze elke onze hun als door bij",
}
_LANG = {w: [k for k, v in MARKERS.items() if w in v.split()] for v in MARKERS.values() for w in v.split()}
CHUNK_TYPE = "array<struct<chars:int,words:int,heaped:int,ratio:double,ends:double,lang:string>>"


def _language(low: list[str]) -> str:
    votes: dict[str, int] = {}
    for w in filter(_LANG.__contains__, low):
        for k in _LANG[w]:
            votes[k] = votes.get(k, 0) + 1
    best = max(votes, key=lambda k: (votes[k], k), default="")
    return best if best and 20 * votes[best] >= len(low) else ""


def chunks(body: list[tuple[str, int, bool, bool]]) -> list[tuple[int, int, int, float, float, str]]:
    """Of (text, words, prose, heaped) blocks: (characters, words, heaped words, ratio, sentence ends per word, language) chunks."""
    out = []
    texts: list[str] = []
    size = words = heaped = 0
    for k, (text, n, _prose, heap) in enumerate(body):
        texts.append(text)
        size += len(text)
        words += n
        heaped += n if heap else 0
        if size >= CHUNK or k == len(body) - 1:
            joined = "\n".join(texts)
            raw = joined.encode()
            ratio = len(zlib.compress(raw, 6)) / max(1, len(raw))
            out.append((len(raw), words, heaped, ratio, len(_ENDS.findall(joined)) / max(1, words), _language(_WORD.findall(joined.lower()))))
            texts, size, words, heaped = [], 0, 0, 0
    return out


def _size(chars: Column) -> Column:
    """The doubling of length that a chunk is in."""
    return F.least(F.lit(23), F.floor(F.log2(F.greatest(chars, F.lit(1))))).cast("int")


def flag_stuffed(judged: DataFrame) -> DataFrame:
    """Adds ``stuffed_words`` and ``stuffed`` to rows with ``residue``, ``other`` and ``chunks``; null where there is no chunk.

    The baseline has at most (languages + 1) x 24 rows, so it is broadcast as one map, and each row is told where it lies: its texts
    aren't moved.
    """
    usual = (
        judged.select(F.explode("chunks").alias("c"))
        .select("c.*")
        .where(F.col("heaped") * 2 <= F.col("words"))
        .groupBy("lang", _size(F.col("chars")).alias("size"))
        .agg(F.percentile_approx("ratio", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias("q"), F.percentile_approx("ends", 0.5, 1000).alias("ends"), F.count("*").alias("n"))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.struct("lang", "size"), F.struct("q", "ends", "n")))).alias("usual"))
    )

    def stuffed_words(c: Column) -> Column:
        u = c["u"]
        spread = F.greatest(u["q"][2] - u["q"][0], F.lit(0.03))
        far = (u["q"][1] - c["ratio"]) / spread
        # a language or length seen too seldom is measured by a rule of thumb: prose of n characters gives about 3.2 / n ** 0.28 - less spread
        thumb = (F.lit(3.6) / F.pow(F.greatest(c["chars"], F.lit(1)).cast("double"), F.lit(0.28)) - c["ratio"]) / F.lit(0.06)
        lies = F.when(u["n"] >= 20, far).otherwise(thumb)
        few_ends = c["ends"] < 0.5 * F.coalesce(u["ends"], F.lit(0.08))
        redundant = (c["chars"] >= LEAST) & ((lies > SPREADS) & few_ends | (lies > 2 * SPREADS))
        return F.when(redundant, c["words"]).otherwise(c["heaped"])

    names = ("chars", "words", "heaped", "ratio", "ends")
    known = F.transform("chunks", lambda c: F.struct(*(c[x].alias(x) for x in names), F.try_element_at("usual", F.struct(c["lang"].alias("lang"), _size(c["chars"]).alias("size"))).alias("u")))
    total = F.aggregate(known, F.lit(0).cast("long"), lambda n, c: n + stuffed_words(c)).cast("int")
    return (
        judged.crossJoin(F.broadcast(usual))
        .withColumn("stuffed_words", F.when(F.size("chunks") > 0, total))
        .drop("usual")
        # more than half of the words, and 12 at least: one comparison, as the sum is computed for each
        .withColumn("stuffed", ~F.col("residual") & F.coalesce(F.col("stuffed_words") > F.greatest(F.shiftright(F.col("residue") + F.col("other"), 1), F.lit(11)), F.lit(False)))
    )
