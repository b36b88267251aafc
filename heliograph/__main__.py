"""Without a window: index folders, search, or time the ranking kernel; the report is one JSON object.

python -m heliograph --library file:///lib --index file:/pictures --query "red sword" --json report.json
"""

from __future__ import annotations

import argparse
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from .operators.indexer import Indexer, Library
from .operators.search import Searcher, top_k
from .schema import Mode, SearchRequest, Sort
from .sources.files import synthetic_vectors


def benchmark(spark: SparkSession, n: int, dimensions: int, runs: int, dropped: int = 5) -> dict:
    """Milliseconds of an exact top 100 over synthetic vectors; p50 = sorted[n / 2], p95 = sorted[floor(0.95 n)]."""
    vectors = synthetic_vectors(spark, n, dimensions).cache()
    vectors.count()
    query = list(vectors.filter("vec_id = 0").head()["embedding"])
    times = []
    for _ in range(runs):
        began = time.perf_counter()
        top_k(vectors, query, 100, dimensions).collect()
        times.append((time.perf_counter() - began) * 1000)
    kept = sorted(times[dropped:])
    vectors.unpersist()
    return {"vectors": n, "dimensions": dimensions, "runs": len(kept), "p50_ms": round(kept[len(kept) // 2], 2), "p95_ms": round(kept[int(len(kept) * 0.95)], 2), "vector_mib": n * dimensions * 4 / (1 << 20)}


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    report: dict = {}
    if args.benchmark:
        report["benchmark"] = benchmark(spark, args.vectors, args.dimensions, args.runs)
    if args.library:
        library = Library(spark, args.library)
        if args.index:
            report["scan"] = Indexer(library).scan(args.index, force=args.force, appearance_only=args.appearance_only)
        searcher = Searcher(library.catalog())
        report["searches"] = []
        for k, text in enumerate(args.query or []):
            result = searcher.search(SearchRequest(query=text, mode=Mode(args.mode), sort=Sort(args.sort), folder=args.folder, favorites=args.favorites, extension=args.extension, limit=args.limit, generation=k + 1))
            rows = [] if result.page is None else [r.asDict() for r in result.page.select("id", "path", "score", "reason").collect()]
            report["searches"].append({"query": text, "total": result.total, "ranked": result.ranked, "status": result.status, "error": result.error, "elapsed_ms": round(result.elapsed_ms, 1), "items": rows})
    return report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="heliograph", description=__doc__)
    p.add_argument("--library", help="folder of the library's tables")
    p.add_argument("--index", action="append", metavar="FOLDER", help="folder to scan (repeatable)")
    p.add_argument("--force", action="store_true", help="look at unchanged files again")
    p.add_argument("--appearance-only", action="store_true", help="make descriptors of known files only")
    p.add_argument("--query", action="append", metavar="TEXT", help="search (repeatable)")
    p.add_argument("--mode", choices=[m.value for m in Mode], default="hybrid")
    p.add_argument("--sort", choices=[s.value for s in Sort], default="relevance")
    p.add_argument("--folder", default="")
    p.add_argument("--favorites", action="store_true")
    p.add_argument("--extension", default="")
    p.add_argument("--limit", type=int, default=300)
    p.add_argument("--benchmark", action="store_true", help="time the exact top 100 over synthetic vectors")
    p.add_argument("--vectors", type=int, default=40_000)
    p.add_argument("--dimensions", type=int, default=512)
    p.add_argument("--runs", type=int, default=35)
    p.add_argument("--json", help="file for the report (else standard output)")
    return p


def write_report(report: dict, path: str | None) -> None:
    """To standard output, or to a file that is replaced as a whole."""
    text = json.dumps(report, ensure_ascii=False, indent=1)
    if not path:
        print(text)
        return
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(path)), delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("heliograph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        write_report(run(args, spark), args.json)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
