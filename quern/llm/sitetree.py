"""Site style trees over a crawl: which blocks of a page are its main body.

Each page is parsed once into branches and blocks (``siteblocks``). The pages of a host are merged into its style tree (Yi, Liu and
Li, "Eliminating Noisy Information in Web Pages for Data Mining", KDD 2003) by counting: a *presentation node* is the style path
of a branch, for cells of a layout with their place; a *content node* a block's masked text (digits and the site's own name
replaced). Copies of an article count as one page. A node that is on N articles of its host and holds a content on d of them
has from it the entropy log d of at most log N; the content's importance is 1 - log d / log N, links have none, and the importance
of a presentation node is the mean over the words it holds:

    importance = (sum of words * (1 - log d / log N)) / words, those of links included

Branches under ``KEEP`` percent are removed, and within the others the content nodes that mostly occur in branches without
other prose. Where fewer than ``LEAST`` pages of a host have a node, it goes by the other hosts' mean; where those are too few,
a branch's own prose decides.

Scale: one parse, no shuffle of texts but the one that finds each page's latest row; counts are pre-aggregated and joined
back on (signature, host, salt), so a host or a footer that owns a third of the crawl is spread over ``SALTS`` tasks.
"""

from __future__ import annotations

import marshal
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import keep
from .pagetext import Block
from .siteblocks import BRANCH_ROW, NOISY, WITH_ARTICLE, WORD_ROW, Facts, Known, article_key, facts, hash64, host_of, signatures, verdict, word_node
from .stuffing import CHUNK_TYPE, flag_stuffed

SALTS = 16
#: Pages with a node from which its importance is told.
LEAST = 6
#: Above this share of occurrences without other prose around a repeated block is of low importance.
NOISE = 0.7
BATCH = 500
#: A node is an answer of sites if so many hosts have it and at most this share of its occurrences is on pages with an article.
HOSTS, ANSWER = 3, 0.2
#: Words that a task counts before it hands its counts on.
WORDS = 200_000

_PARSED = (
    "page_id long, loaded long, tie long, host long, article long, idx array<int>, sig array<long>, how array<byte>, words array<int>, element array<long>, "
    "visible string, body binary, url string"
)
_JUDGED = f"page_id long, lines array<int>, text string, residue int, other int, chunks {CHUNK_TYPE}, visible string, url string, loaded long"


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, source, loaded): null page_ids are dropped, other columns ignored, a missing url or loaded_at is null."""
    def col(name: str, kind: str):
        return F.col(name).cast(kind) if name in pages.columns else F.lit(None).cast(kind)

    source = F.coalesce(F.when(col("content", "string") != "", col("content", "string")), col("html", "string"))
    loaded = F.unix_micros(col("loaded_at", "timestamp"))
    return pages.select(col("page_id", "long").alias("page_id"), col("url", "string").alias("url"), source.alias("source"), loaded.alias("loaded")).where("page_id is not null")


def _parse(batches: Iterator[pa.RecordBatch], keys: bool = True) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema(
        [("page_id", pa.int64()), ("loaded", pa.int64()), ("tie", pa.int64()), ("host", pa.int64()), ("article", pa.int64()), ("idx", pa.list_(pa.int32())),
         ("sig", pa.list_(pa.int64())), ("how", pa.list_(pa.int8())), ("words", pa.list_(pa.int32())), ("element", pa.list_(pa.int64())), ("visible", pa.string()), ("body", pa.binary()), ("url", pa.string())]
    )
    spoken: Counter[str] = Counter()
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            ids, urls, sources, loaded = (batch.column(k).to_pylist() for k in range(4))
            rows: list[list] = [[] for _ in kinds]
            for page_id, url, source, when in zip(ids, urls, sources, loaded):
                host = host_of(url)
                page = facts(source, host, words := set(), shown := [] if keys else None)
                spoken.update(words)
                nodes = signatures(page)
                key = shown[0] if shown else ""
                row = (
                    page_id, when, hash64(source or ""), hash64(host), article_key(page, host), *([n[c] for n in nodes] for c in range(5)), _digest(key), marshal.dumps([(*f.block, *f[1:4], 0) for f in page]), url,
                )
                for column, value in zip(rows, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(rows, kinds)], schema=kinds)
            if len(spoken) > WORDS:
                yield _vocabulary(spoken, kinds)
                spoken.clear()
    if spoken:
        yield _vocabulary(spoken, kinds)


def _vocabulary(spoken: Counter[str], kinds: pa.Schema) -> pa.RecordBatch:
    """A row without an id: in how many of a task's pages each word is in prose."""
    known = {"idx": [list(spoken.values())], "sig": [[word_node(w) for w in spoken]]}
    return pa.RecordBatch.from_arrays([pa.array(known.get(kind.name, [None]), kind.type) for kind in kinds], schema=kinds)


def _digest(key: str) -> str | None:
    import xxhash

    return xxhash.xxh3_128_hexdigest(key) if key else None


def _judge(batches: Iterator[pa.RecordBatch], texts: bool = True, stuffing: bool = True) -> Iterator[pa.RecordBatch]:
    chunk = pa.struct([("chars", pa.int32()), ("words", pa.int32()), ("heaped", pa.int32()), ("ratio", pa.float64()), ("ends", pa.float64()), ("lang", pa.string())])
    kinds = pa.schema(
        [("page_id", pa.int64()), ("lines", pa.list_(pa.int32())), ("text", pa.string()), ("residue", pa.int32()), ("other", pa.int32()), ("chunks", pa.list_(chunk)), ("visible", pa.string()), ("url", pa.string()), ("loaded", pa.int64())]
    )
    names = [f.name for f in chunk]
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            rows: list[list] = [[] for _ in kinds]
            for page_id, tie, key, body, url, when, *seen in zip(*columns):
                page = [Facts(Block(*f[:6]), *f[6:]) for f in marshal.loads(body)]
                low, answers, fill, importance = set(), set(), set(), {}
                for of, i, n in zip(*seen) if seen[0] else ():
                    if of != tie:
                        continue
                    if i < BRANCH_ROW:
                        if n & LOW:
                            low.add(i)
                        if n & ANSWERED:
                            answers.add(i)
                    elif i < WORD_ROW:
                        importance[i - BRANCH_ROW] = n
                    else:
                        fill.add(i - WORD_ROW)
                known = Known(frozenset(low), importance, frozenset(answers), frozenset(fill))
                v = verdict(page, known, url, stuffing)
                for column, value in zip(rows, (page_id, v.lines, v.text if texts else None, v.residue, v.other, [dict(zip(names, c)) for c in v.chunks], key, url, when)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(rows, kinds)], schema=kinds)


LOW, ANSWERED = 1, 2


def _evidence(parsed: DataFrame) -> DataFrame:
    """(page_id, tie, node, value): what the merged trees say of the nodes of each page that they say anything of. A block is
    listed if it is of low importance or an answer of many sites; a branch has the importance of its node in percent; a word of a
    heap is listed if heaps of many hosts have it and prose hardly ever."""
    nodes = parsed.where("page_id is not null").select("page_id", "tie", "host", "article", F.explode(F.arrays_zip("idx", "sig", "how", "words", "element")).alias("n")).select(
        "page_id", "tie", "host", "article", "n.*"
    )
    spoken = parsed.where("page_id is null").select(F.explode(F.arrays_zip("idx", "sig")).alias("n")).groupBy(F.col("n.sig").alias("sig")).agg(F.sum("n.idx").alias("spoken"))
    salt = F.pmod("article", F.lit(SALTS)).cast("int")
    how = F.col("how").bitwiseAND(F.lit(3))
    by_article = nodes.groupBy("sig", "host", "element", "article").agg(
        F.count_if(how == NOISY).cast("int").alias("noisy"), F.count_if(how <= NOISY).cast("int").alias("of"), F.count_if(F.col("how") >= WITH_ARTICLE).cast("int").alias("beside"),
        F.count("*").cast("int").alias("times"), F.sum("words").alias("words"), F.max(F.col("idx") >= WORD_ROW).alias("word"),
    )
    counts = ("noisy", "of", "beside", "times", "words")
    places = by_article.groupBy("sig", "host", "element").agg(
        F.count("*").cast("int").alias("pages"), *(F.sum(c).alias(c) for c in counts), F.max("word").alias("word"), F.bit_or(F.expr(f"shiftleft(1, cast(pmod(article, {SALTS}) as int))")).alias("salts")
    )
    # a row for each node, host and branch: what the pages of a host share is one row here, so no signature is too many rows for a task
    places = keep(places.repartition(int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sig"), now=True)
    by_host = places.where("sig <> element").groupBy("sig", "host").agg(*(F.sum(c).alias(c) for c in ("pages", *counts[:4])), F.max("word").alias("word"), F.bit_or("salts").alias("salts"))
    by_crawl = by_host.groupBy("sig").agg(F.count("*").cast("int").alias("hosts"), *(F.sum(c).alias(f"all_{c}") for c in ("pages", *counts[:4])), F.max("word").alias("is_word"), F.max("pages").alias("most")).where("all_pages > 2")
    everywhere = F.try_divide("all_noisy", "all_of")
    # a repeated node amid prose is the article's own, so is one that no host has on several articles, as an article's copies have;
    # without markup anywhere to tell, what many pages of the host have is not
    low = F.when(everywhere.isNull(), F.col("pages") > 2).otherwise((everywhere >= NOISE) & (F.col("most") > 2))
    answer = (F.col("hosts") >= HOSTS) & (F.col("all_beside") <= ANSWER * F.col("all_times"))
    fill = answer & (F.coalesce("spoken", F.lit(0)) <= ANSWER * F.col("all_pages"))
    tree = (
        by_host.join(by_crawl, "sig")
        .join(spoken, "sig", "left")
        .select(
            F.xxhash64("sig", "host").alias("node"),
            F.when(F.col("is_word"), F.when(fill, 1)).otherwise(F.nullif(F.when(low, LOW).otherwise(0) + F.when(answer, ANSWERED).otherwise(0), F.lit(0))).alias("value"),
            "salts",
        )
        .where("value is not null")
        .unionByName(_importance(places))
        .select("node", "value", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("salts", k) == 1)).alias("salt"))
    )
    return (
        nodes.select("page_id", "tie", "idx", F.xxhash64("sig", "host").alias("node"), salt.alias("salt"))
        .join(tree.hint("shuffle_hash"), ["node", "salt"])
        .groupBy("page_id")
        .agg(F.collect_list(F.struct("tie", "idx", "value")).alias("evidence"))
    )


def _importance(places: DataFrame) -> DataFrame:
    """(node, value, salts): of each branch's node on each host its importance in percent; where too few pages of the host have it,
    that of other hosts, if there are enough. The signature of such a node is its element's, which no content has."""
    own = F.col("sig") == F.col("element")
    of_node = lambda c: F.max(F.when(own, F.col(c)))
    nodes = places.where("element <> 0").groupBy("element", "host").agg(
        of_node("pages").alias("pages"), of_node("words").alias("words"), of_node("salts").alias("salts"),
        F.sum(F.when(~own, F.col("words"))).alias("held"), F.sum(F.when(~own, F.col("words") * F.log("pages"))).alias("h"),
    )
    here = F.when(F.col("pages") >= LEAST, (F.coalesce("held", F.lit(0)) - F.coalesce("h", F.lit(0.0)) / F.log("pages")) / F.greatest("words", F.lit(1)))
    nodes = nodes.select("element", "host", "salts", here.alias("here"))
    others = nodes.where("here is not null").groupBy("element").agg(F.avg("here").alias("others"), F.count("*").alias("hosts")).where(f"hosts >= {HOSTS}")
    value = F.coalesce("here", "others")
    return (
        nodes.join(others, "element", "left")
        .where(value.isNotNull())
        .select(F.xxhash64(F.col("element"), F.col("host")).alias("node"), F.greatest(F.round(100 * value), F.lit(0)).cast("int").alias("value"), "salts")
    )


def latest(rows: DataFrame) -> DataFrame:
    """Of several rows (page_id, url, source, loaded) of a page the one loaded last, of those the one with the largest hash of its source."""
    by = Window.partitionBy("page_id").orderBy(F.col("loaded").desc_nulls_last(), F.xxhash64("source", "url").desc())
    return rows.withColumn("turn", F.row_number().over(by)).where("turn = 1").drop("turn")


_SEEN = ("tie", "idx", "value")


def judge_pages(pages: DataFrame, texts: bool = False, keys: bool = False, stuffing: bool = True) -> DataFrame:
    """One row for each page: ``lines`` and ``text`` of the main body, whether the page is ``residual`` (its body is template
    residue, filler, error text or a script notice) or ``stuffed`` (keywords, lists of tags or links), and ``visible``, a
    digest of its visible letters and digits (null without any), its ``url`` and when it was ``loaded``. Of several rows of a page the one loaded last counts,
    then the one with the largest hash of its source.

    ``text`` and ``visible`` cost time and are null unless asked for by ``texts`` and ``keys``; without ``stuffing`` there is no ``stuffed``.

    Null or empty sources give empty lines, no flag and null ``visible``.
    """
    parsed = keep(page_rows(pages).mapInArrow(partial(_parse, keys=keys), _PARSED), now=True)
    latest = (
        parsed.where("page_id is not null").select("page_id", "loaded", "tie", "visible", "body", "url")
        .withColumn("turn", F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("loaded").desc_nulls_last(), F.col("tie").desc())))
        .where("turn = 1")
    )
    judged = keep(
        latest.join(_evidence(parsed), "page_id", "left")
        .select("page_id", "tie", "visible", "body", "url", "loaded", *(F.col(f"evidence.{c}").alias(f"seen_{c}") for c in _SEEN))
        .mapInArrow(partial(_judge, texts=texts, stuffing=stuffing), _JUDGED)
        .withColumn("residual", (F.col("residue") > 0) & (F.col("residue") > F.col("other"))),
        now=True,
    )
    return flag_stuffed(judged) if stuffing else judged


def main_lines(judged: DataFrame) -> DataFrame:
    """(page_id, line_no) of the main bodies of pages that are neither residue nor stuffed."""
    return judged.where("not residual and not stuffed").select("page_id", F.explode("lines").alias("line_no"))
