"""The queries of the training-data operators. Each runs over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import bucketed, written
from . import canonical, distinctive, langid, leakage, neardup, packing, sitetree


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.judge_pages(_table(spark, sf_dir, "pages"), stuffing=False).where("residual").select("page_id")


def _scored(spark: SparkSession, sf_dir: str, divergence: bool) -> DataFrame:
    return distinctive.score_terms(_table(spark, sf_dir, "postings"), _table(spark, sf_dir, "docinfo"), divergence)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.best_term(_scored(spark, sf_dir, False), F.col("tfidf")).select("doc_id", "term")


def p2_dfr(spark: SparkSession, sf_dir: str) -> DataFrame:
    # weights are rounded, so that the last digits of a sum don't decide
    return distinctive.best_term(_scored(spark, sf_dir, True), F.round("dfr", 6)).withColumnRenamed("weight", "dfr")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.main_lines(sitetree.judge_pages(_table(spark, sf_dir, "pages")))


#: Words of a shingle and Jaccard similarity that count as alike here; at least so many entries has a list that is compared.
SHINGLE, ALIKE, ENTRIES = 3, 0.6, 4


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = sitetree.judge_pages(_table(spark, sf_dir, "pages"), texts=True, keys=True)
    articles = judged.where("not residual and not stuffed and size(lines) > 0").select(F.col("page_id").alias("id"), "text", F.xxhash64("visible").alias("tag"))
    sets = bucketed(neardup.word_sets(articles, SHINGLE), "articles", "id")  # joined by id again and again, moved once
    pairs = neardup.expand(*neardup.near_duplicates(sets, ALIKE))
    pages = (
        pairs.join(sets.select(F.col("id").alias("id_a"), F.col("tag").alias("tag_a")), "id_a")
        .join(sets.select(F.col("id").alias("id_b"), F.col("tag").alias("tag_b")), "id_b")
        .where("tag_a <> tag_b")  # a page with a main body has visible text
    )
    docs = p4_lists(spark, sf_dir)
    return pages.select(F.lit("page").alias("kind"), "id_a", "id_b").unionByName(docs.select(F.lit("docinfo").alias("kind"), "id_a", "id_b"))


def p4_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of addresses alone."""
    latest = Window.partitionBy("doc_id").orderBy(F.col("built_at").desc_nulls_last(), F.xxhash64("dup_urls"))
    lists = _table(spark, sf_dir, "docinfo").where("doc_id is not null").select("doc_id", "built_at", "dup_urls").withColumn("turn", F.row_number().over(latest)).where("turn = 1")
    sets = neardup.value_sets(lists.select(F.col("doc_id").alias("id"), F.col("dup_urls").alias("items"))).where(F.size("elements") >= ENTRIES)
    return neardup.expand(*neardup.near_duplicates(written(sets, "lists"), ALIKE, exact=True))  # short lists


def _keyed_urls(pages: DataFrame) -> DataFrame:
    return canonical.with_canonical_url(pages, "url", "place").select("loaded", F.col("page_id").alias("id"), F.concat(F.lit("url:"), "place").alias("key"))


def _copies(rows: DataFrame) -> DataFrame:
    """(kind, first_id, copy_id) of (loaded, id, key), in two deliveries: what was loaded on time, and what came a week or more after
    half of the rows had come; a row without a time comes with the first."""
    rows = written(rows.where("key is not null"), "keys")
    half = rows.agg(F.percentile_approx("loaded", 0.5)).first()[0] or 0
    late = F.coalesce(F.col("loaded") > half + 7 * 86_400_000_000, F.lit(False))
    counts, _ = canonical.duplicates_in(rows, [~late, late])
    return canonical.copies_of(rows, counts).select(F.substring_index("key", ":", 1).alias("kind"), "first_id", "copy_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = canonical.with_canonical_url(sitetree.judge_pages(_table(spark, sf_dir, "pages"), keys=True), "url", "place")
    content = F.concat(F.lit("content:"), F.when(~F.col("residual") & ~F.col("stuffed"), F.col("visible")))
    url = F.concat(F.lit("url:"), "place")
    return _copies(judged.select("loaded", F.col("page_id").alias("id"), F.explode(F.array(content, url)).alias("key")))


def p6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses alone, of each page's latest row."""
    return _copies(_keyed_urls(sitetree.latest(sitetree.page_rows(_table(spark, sf_dir, "pages"))))).select("first_id", "copy_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.judge_pages(_table(spark, sf_dir, "pages")).where("stuffed").select("page_id")


def _langcodes(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    return [(r.lang, r.lang_name) for r in _table(spark, sf_dir, "langcodes").select("lang", "lang_name").distinct().collect()]  # the languages there are


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.mislabelled(langid.assign_languages(_table(spark, sf_dir, "documents"), _langcodes(spark, sf_dir)))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_sizes(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "capacities"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing: of each capacity how many documents are placed, and how many containers are too full, documents
    are placed in part or twice, and documents are cut that fit whole; and whether nine tenths of the room are used."""
    sizes = written(packing.token_sizes(_table(spark, sf_dir, "documents")), "sizes")
    most = _table(spark, sf_dir, "capacities").groupBy("capacity_id").agg(F.max("max_tokens").alias("most"))
    placed = written(packing.pack(sizes, _table(spark, sf_dir, "capacities")), "placed")
    loads = placed.groupBy("capacity_id", "container").agg(F.sum("tokens").alias("load")).join(most, "capacity_id")
    of_room = loads.groupBy("capacity_id").agg(F.count_if(F.col("load") > F.col("most")).alias("too_full"), (F.sum("load") >= 0.9 * F.sum("most")).alias("filled"))
    docs = placed.groupBy("capacity_id", "doc_id").agg(F.sum("tokens").alias("got"), F.count("*").alias("parts")).join(sizes, "doc_id").join(most, "capacity_id")
    of_docs = docs.groupBy("capacity_id").agg(
        F.count("*").alias("placed"), F.count_if(F.col("got") != F.col("tokens")).alias("wrong"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= F.col("most"))).alias("cut")
    )
    return of_docs.join(of_room, "capacity_id").select("capacity_id", "placed", "wrong", "cut", "too_full", "filled")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leakage.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.where(F.col("run") >= leakage.RUN).select("doc_id", "item_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_dfr, p3_found, p4_found, p4_lists, p6_found, p6_urls, p7_found, p8_pack, p8_kept, p9_found, p10_found)}


_PAIRS = "p as (select term, doc_id, max(case when tfw > 0 then tfw end) tf from postings where term is not null and doc_id is not null group by all)"
_TERMS = "t as (select term, count(*) df, sum(tf) f from p group by term), n as (select count(distinct doc_id)::double n from docinfo)"


# White space and what is blank like it, as an RE2 class.
_BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_FORM = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?]*)([^?]*)(\?.*)?$"


def oracle_sql() -> dict[str, str]:
    return {
        "p4_lists": """with d as (select doc_id, dup_urls from docinfo where doc_id is not null qualify row_number() over (partition by doc_id order by built_at desc nulls last) = 1),
            e as (select distinct doc_id, unnest(dup_urls) u from d), k as (select doc_id, count(*) n from e where u is not null group by 1 having count(*) >= 4),
            c as (select a.doc_id id_a, b.doc_id id_b, count(*) c from e a join e b on a.u = b.u and a.doc_id < b.doc_id group by all)
            select id_a, id_b from c join k x on x.doc_id = id_a join k y on y.doc_id = id_b where c >= 0.6 * (x.n + y.n - c) - 1e-9""",
        "p6_urls": rf"""with p as (select page_id, url from pages where page_id is not null qualify row_number() over (partition by page_id order by loaded_at desc nulls last) = 1),
            t as (select page_id, regexp_replace(regexp_replace(url, '^{_BLANK}|{_BLANK}$', '', 'g'), '(?s)#.*$', '') t from p where url is not null),
            x as (select page_id, t, regexp_matches(t, '{_FORM}') whole, lower(regexp_extract(t, '{_FORM}', 1)) s, regexp_extract(t, '{_FORM}', 2) h, regexp_extract(t, '{_FORM}', 3) path, regexp_extract(t, '{_FORM}', 4) q from t where t <> ''),
            k as (select page_id, case when whole then s || '://' || regexp_extract(h, '^(.*@)?', 0) || regexp_replace(lower(regexp_replace(h, '^.*@', '')), case s when 'http' then ':(80)?$' when 'https' then ':(443)?$' else ':$' end, '') || path
                || case when q <> '' then '?' || array_to_string(list_sort(string_split(substr(q, 2), '&')), '&') else '' end else t end key from x),
            f as (select page_id, min(page_id) over (partition by key) first_id from k) select first_id, page_id copy_id from f where page_id <> first_id""",
        "p8_kept": """select capacity_id, (select count(distinct doc_id) from documents where text <> '') placed, 0::bigint wrong, 0::bigint cut, 0::bigint too_full, true filled
            from (select distinct capacity_id from capacities)""",
        "p9_found": r"""with d as (select doc_id id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') w from documents), i as (select item_id id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') w from benchmark),
            dg as (select id, array_to_string(w[k:k + 12], ' ') g from d, unnest(range(1, greatest(1, len(w) - 11))) x(k)), ig as (select id, array_to_string(w[k:k + 12], ' ') g from i, unnest(range(1, greatest(1, len(w) - 11))) x(k))
            select distinct dg.id doc_id, ig.id item_id from dg join ig using (g)""",
        "p2_found": f"""with {_PAIRS}, {_TERMS},
            w as (select doc_id, term, (1 + log10(tf)) * log10(n.n / df) w from p join t using (term), n where tf is not null)
            select doc_id, term from w qualify row_number() over (partition by doc_id order by w desc, term) = 1""",
        "p2_dfr": f"""with {_PAIRS}, {_TERMS}, l as (select doc_id, sum(tf) len from p group by doc_id), a as (select sum(tf) / any_value(n.n) av from p, n),
            v as (select doc_id, term, tf * log2(1 + a.av / l.len) tfn, f / n.n r from p join t using (term) join l using (doc_id), n, a where tf is not null),
            w as (select doc_id, term, round((log2(1 + r) + tfn * log2((1 + r) / r)) / (tfn + 1), 6) dfr from v)
            select doc_id, term, dfr from w qualify row_number() over (partition by doc_id order by dfr desc, term) = 1""",
    }
