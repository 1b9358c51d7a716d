"""Reading pages: folders of JSON files, one page each, and tables of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dedup import latest_rows
from ..storage import written


def json_folder(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, url, source) of the .json files at any depth, in the order of their paths. Files that aren't a JSON object
    with a field keep their number and have a null source; a missing url is the path, missing content the html, else ""."""
    raw = (
        spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").load(root).select(F.input_file_name().alias("path"), "value")
    )
    page = F.from_json("value", "url string, content string, html string")
    usable = F.coalesce(F.size(F.json_object_keys("value")) > 0, F.lit(False))
    rows = raw.select("path", F.when(usable, page).alias("page"), usable.alias("usable"))
    return _numbered(rows).select(
        "doc_id",
        "path",
        F.when(F.col("usable"), F.coalesce(F.nullif(F.col("page.url"), F.lit("")), F.col("path"))).alias("url"),
        F.when(F.col("usable"), F.coalesce(F.nullif(F.col("page.content"), F.lit("")), F.col("page.html"), F.lit(""))).alias("source"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Dense numbers from 1 in path order without sorting in one task: ranges of paths, a count of each range, a number within. The
    ranges are written with their number before they are counted, so both see the same rows whatever the plan of either."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = written(rows.repartitionByRange(ranges, "path").withColumn("part", F.spark_partition_id()), "paths")
    counts = spread.groupBy("part").agg(F.count("*").alias("n"))  # at most ``ranges`` rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    return spread.withColumn("k", number).join(F.broadcast(counts.select("part", before.alias("before"))), "part").withColumn("doc_id", (F.col("before") + F.col("k")).cast("long"))


def page_table(pages: DataFrame) -> DataFrame:
    """(doc_id, path, url, source) of a table of page rows: doc_id is page_id + 1, of repeated rows the one loaded last counts."""
    rows = latest_rows(pages.where("page_id is not null"), "page_id", [F.col("loaded_at").desc_nulls_last(), F.xxhash64("content", "html")])
    return rows.select(
        (F.col("page_id") + 1).alias("doc_id"),
        F.col("src_path").alias("path"),
        F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("src_path")).alias("url"),
        F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("html"), F.lit("")).alias("source"),
    )
