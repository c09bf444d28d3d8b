"""Evaluation of a search: recall, probes, latency, gates."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import engine
from lodestone.operators import papers as P
from lodestone.operators.index import Index
from lodestone.operators.numbering import numbered

#: Thresholds that a report is held against.
LEAST_RECALL, BUDGET_MS, STORAGE_BYTES, FULL_RECORDS = 0.95, 200.0, 800_000_000_000, 340_800_000


def latency_summary(runs: DataFrame, by: str, value: str = "ms") -> DataFrame:
    """By group: requests, p50, p95, p99 (linear between ranks) and mean."""
    x = F.col(value)
    return runs.groupBy(by).agg(F.count("*").alias("requests"), *[F.percentile(x, p / 100).alias(f"p{p}") for p in (50, 95, 99)], F.avg(x).alias("mean"))


def errors_by_name(runs: DataFrame, error: str = "error") -> DataFrame:
    return runs.filter(F.col(error).isNotNull()).groupBy(error).agg(F.count("*").alias("n"))


def title_probe(index: Index, title: str, vector: list[float], limit: int = 20) -> tuple[bool, int | None]:
    """Whether a search finds a title that holds the typed one, and at which place."""
    page = engine.search(index, title, vector, limit=limit).page
    key = X.plain_key(title)
    at = page.filter(F.contains(F.concat(F.lit(" "), X.normalize_title(F.col("title")), F.lit(" ")), F.lit(key))).agg(F.min("pos")).first()[0]
    return at is not None, at


def selective_check(index: Index, query: str, vector: list[float]) -> tuple[int, int, bool]:
    """(rarest year, its papers, whether a search for it shows nothing else)."""
    years = {int(y): n for y, n in index.manifest["years"].items()}
    year = min(years, key=lambda y: (years[y], y))
    found = engine.search(index, query, vector, filters=P.Filters(year_min=year, year_max=year), limit=20)
    right = found.page.agg(F.coalesce(F.bool_and(F.col("publication_year") == year), F.lit(True))).first()[0]
    return year, found.counters.first()["filtered_records"], right


def measured(call: Callable[[], object], repeats: int) -> list[tuple[float, str | None]]:
    """(milliseconds, name of the error or None) of each call."""
    out = []
    for _ in range(repeats):
        began, error = time.perf_counter(), None
        try:
            call()
        except Exception as e:  # an error is a result here
            error = type(e).__name__
        out.append(((time.perf_counter() - began) * 1000, error))
    return out


def concurrent(call: Callable[[], object], repeats: int, levels: tuple[int, ...] = (1, 2, 4)) -> list[dict]:
    """For each number of callers at once: requests, seconds, requests a second, and each
    call's (milliseconds, error).  Spark runs the callers' jobs side by side."""
    out = []
    for level in levels:
        began = time.perf_counter()
        with ThreadPoolExecutor(level) as pool:
            runs = [r for part in pool.map(lambda _: measured(call, 1), range(repeats)) for r in part]
        took = time.perf_counter() - began
        out.append({"callers": level, "requests": len(runs), "seconds": took, "qps": len(runs) / max(took, 1e-9), "runs": runs})
    return out


def gates(candidate: float, refined: float, probes_ok: bool, filter_ok: bool, bytes_per_record: float, p99: float, errors: int) -> dict:
    """Which thresholds a report passes, and the projected size of the full corpus."""
    projected = bytes_per_record * FULL_RECORDS
    return {
        "candidate_recall": candidate >= LEAST_RECALL, "refined_recall": refined >= LEAST_RECALL, "titles": probes_ok, "filter": filter_ok,
        "storage": projected <= STORAGE_BYTES, "latency": errors == 0 and p99 <= BUDGET_MS, "projected_bytes": projected,
    }


def compare_runs(now: DataFrame, before: DataFrame) -> DataFrame:
    """(query_id, change): rank better, worse or same as in a run before; a rank that is
    missing counts as behind all."""
    rank = lambda c: F.coalesce(c, F.lit(2**31 - 1))
    both = now.select("query_id", F.col("rank").alias("a")).join(before.select("query_id", F.col("rank").alias("b")), "query_id", "full")
    change = F.when(rank(F.col("a")) < rank(F.col("b")), "better").when(rank(F.col("a")) > rank(F.col("b")), "worse").otherwise("same")
    return both.select("query_id", change.alias("change"))


def suspects(patches: DataFrame) -> DataFrame:
    """work_id of corrections that mark a count as unreliable: what a labelled run flags."""
    return patches.filter(F.coalesce("unreliable", F.lit(False))).select("work_id").distinct()


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(value, code): values of a column numbered in order from 0."""
    values = rows.select(F.col(column).alias("value")).distinct()
    return numbered(values, F.col("value").asc_nulls_first(), name="code").withColumn("code", F.col("code").cast("int"))
