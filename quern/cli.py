"""python -m quern.cli build ROOT OUT | search OUT | serve OUT [PORT]"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from .plans.build import Index, build_index, parse_zones
from .sources.pages import json_folder
from .storage import ship


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("quern").getOrCreate()
    ship(spark)
    return spark


def build(root: str, out: str) -> dict:
    pages = json_folder(_session(), root).cache()
    n = pages.count()
    index = build_index(parse_zones(pages), n_paths=n)
    index.save(out)
    stats = index.stats.first().asDict()
    print(f"{stats['n_paths']} pages scanned, {stats['n_indexed']} indexed, {stats['n_paths'] - stats['n_indexed']} eliminated")
    return stats


def answer(index: Index, text: str) -> list[str]:
    began = time.perf_counter()
    rows = index.search(text).orderBy("rank").collect()
    took = (time.perf_counter() - began) * 1000
    return [f"{r['rank']:>3}. {r['score']:.6f}  {r['url']}" for r in rows] + [f"{took:.1f} ms, {rows[0]['candidates'] if rows else 0} candidates"]


def search(out: str) -> None:
    index = Index.load(_session(), out).cached()
    while True:
        try:
            text = input("query> ").strip()
        except EOFError:
            return
        if not text:
            return
        print("\n".join(answer(index, text)))


def main(args: list[str]) -> int:
    if len(args) == 3 and args[0] == "build":
        build(args[1], args[2])
    elif len(args) == 2 and args[0] == "search":
        search(args[1])
    elif len(args) in (2, 3) and args[0] == "serve":
        from .http import serve

        serve(Index.load(_session(), args[1]).cached(), int(args[2]) if len(args) > 2 else 5000)
    else:
        print(__doc__, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
