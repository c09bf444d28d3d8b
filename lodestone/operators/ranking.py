"""Ranking of candidates: spread-scaled score, floor, sorts, window, pages."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X

CITATION_WEIGHT = 0.15
PREFIX_BONUS = 0.15
TITLE_BONUS = 0.25
RERANK_WINDOW = 40
SORTS = ("relevance", "most_cited", "newest", "oldest")


def spread(pool: DataFrame) -> DataFrame:
    """One row of the semantic pool's spread, scale and relevance floor."""
    s = pool.agg(F.max("sem").alias("top"), F.min("sem").alias("low"))
    gap = F.coalesce(F.col("top") - F.col("low"), F.lit(0.0))
    scale = F.when(gap == 0, F.lit(1.0)).otherwise(F.least(F.greatest(gap / 0.10, F.lit(0.25)), F.lit(2.0)))
    return s.select(gap.alias("spread"), scale.alias("scale"), (F.coalesce("top", F.lit(0.0)) - 0.5 * gap).alias("floor"))


def ranked(candidates: DataFrame, pool: DataFrame, citations: str = "cited_by_count") -> DataFrame:
    """Add ``scale``, ``floor`` and ``score`` to candidates (row_id, sem,
    publication_year, cited_by_count, exact, prefix, matched)."""
    base = candidates.crossJoin(F.broadcast(spread(pool)))
    bonus = F.when(F.col("exact"), F.lit(1.0)).when(F.col("prefix"), PREFIX_BONUS * F.col("scale")).when(F.col("matched"), F.lit(TITLE_BONUS)).otherwise(F.lit(0.0))
    boost = (X.citation_boost(F.col(citations)) * CITATION_WEIGHT + X.recency_boost(F.col("publication_year"))) * F.col("scale")
    return base.withColumn("score", F.col("sem") + boost + bonus)


def order(sort: str, citations: str = "cited_by_count") -> list[Column]:
    """Sort keys; scores that agree to 9 places are equal, as engines add in other orders."""
    exact, score, cited, year = F.col("exact"), F.round("score", 9).desc(), F.desc(citations), F.col("publication_year")
    if sort == "relevance":
        return [F.when(exact, 0).otherwise(1), F.when(exact, F.col(citations)).desc_nulls_last(), score, cited, F.asc("row_id")]
    if sort == "most_cited":
        return [cited, score, F.asc("row_id")]
    if sort in ("newest", "oldest"):
        return [F.when(year > 0, 0).otherwise(1), year.desc() if sort == "newest" else year.asc(), score, F.asc("row_id")]
    raise ValueError(f"sort must be one of {SORTS}")


def positions(rows: DataFrame, sort: str = "relevance", citations: str = "cited_by_count") -> DataFrame:
    """Add ``pos`` from 1.  Other sorts than relevance keep exact titles and rows at
    or above the floor only.  Candidates of one query are a bounded pool."""
    if sort != "relevance":
        rows = rows.filter(F.col("exact") | (F.col("sem") >= F.col("floor")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order(sort, citations))))


def penalised(rows: DataFrame, window: int = RERANK_WINDOW, multi_word: bool = True) -> DataFrame:
    """Rows of the window without a snippet lose 0.03 of the scale, for queries of more
    than one word."""
    if not multi_word:
        return rows
    blank = (F.col("pos") <= window) & (F.trim(F.coalesce("snippet", F.lit(""))) == "")
    return rows.withColumn("score", F.col("score") - F.when(blank, 0.03 * F.col("scale")).otherwise(0.0))


def window_order(rows: DataFrame, sort: str, citations: str = "cited_by_count", window: int = RERANK_WINDOW) -> DataFrame:
    """Put the rows of the window in order anew; those behind it stay where they are."""
    inside = F.when(F.col("pos") <= window, 0).otherwise(1)
    within = Window.partitionBy("query_id").orderBy(inside, F.when(inside == 1, F.col("pos")), *order(sort, citations))
    return rows.withColumn("pos", F.row_number().over(within))


def same_work(a: dict, b: dict) -> bool:
    """Equal DOIs make one work.  Else, where both have a first author, the surnames
    decide; where one has none, years at most one apart do."""
    if a["doi"] and a["doi"] == b["doi"]:
        return True
    if a["surname"] and b["surname"]:
        return a["surname"] == b["surname"]
    return a["year"] > 0 and b["year"] > 0 and abs(a["year"] - b["year"]) <= 1


class Kept:
    """The kept rows of one title, found by DOI, surname and year: a row is compared with
    those alone that may be the same work (``same_work``), however many are kept."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self._at: dict[tuple, list[int]] = {}

    @staticmethod
    def _marks(r: dict) -> Iterator[tuple]:
        if r["doi"]:
            yield "doi", r["doi"]
        if r["surname"]:
            yield "surname", r["surname"]
        if r["year"] > 0:
            yield "year", r["year"], bool(r["surname"])

    def _first(self, r: dict) -> int | None:
        """The first kept row that is the same work."""
        marks = [("doi", r["doi"])] if r["doi"] else []
        if r["surname"]:
            marks.append(("surname", r["surname"]))
        if r["year"] > 0:
            marks += [("year", y, named) for y in range(r["year"] - 1, r["year"] + 2) for named in ((False,) if r["surname"] else (False, True))]
        return min((own[0] for m in marks if (own := self._at.get(m))), default=None)

    def take(self, r: dict) -> int | None:
        """The place of a row that is new, or None; a verified record, else the more cited
        one, takes the place of the same work."""
        hit = self._first(r)
        if hit is None:
            for m in self._marks(r):
                self._at.setdefault(m, []).append(len(self.rows))
            self.rows.append(r)
            return len(self.rows) - 1
        old = self.rows[hit]
        if r["verified"] if r["verified"] != old["verified"] else r["citations"] > old["citations"]:
            for m in self._marks(old):
                self._at[m].remove(hit)
            for m in self._marks(r):
                insort(self._at.setdefault(m, []), hit)
            self.rows[hit] = r | {"pos": old["pos"]}
        return None


def _needed(rows: DataFrame) -> list[Column]:
    verified = F.col("verified") if "verified" in rows.columns else F.lit(False)
    return [F.col("normalized_title"), X.doi(F.col("doi")).alias("doi"), X.surname(F.col("authors")).alias("surname"), F.coalesce("publication_year", F.lit(0)).alias("year"), F.coalesce("citations", F.lit(0)).alias("citations"), verified.alias("verified")]


def collapse(rows: DataFrame, window: int = RERANK_WINDOW) -> DataFrame:
    """Drop repeats of one work within each query's window: rows are taken in order
    and compared with kept rows of the same title that is not empty; a verified record,
    else the more cited one, takes the earlier place.  Needs query_id, pos, row_id,
    normalized_title, doi, authors, publication_year, citations; ``verified`` is
    optional.  At most ``window`` rows a query go to Python.  Returns query_id, row_id
    and a gapless pos in the old order (see ``window_order``)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        of_title: dict[str, Kept] = {}
        alone = []
        for r in part.sort_values("pos").to_dict("records"):
            if r["normalized_title"]:
                of_title.setdefault(r["normalized_title"], Kept()).take(r)
            else:
                alone.append(r)
        kept = sorted([*alone, *(r for own in of_title.values() for r in own.rows)], key=lambda r: r["pos"])
        out = pd.DataFrame(kept, columns=part.columns)[["query_id", "pos", "row_id"]]
        return out.astype({"query_id": "int64", "pos": "int32", "row_id": "int64"})

    needed = rows.select("query_id", "pos", "row_id", *_needed(rows))
    head = needed.filter(F.col("pos") <= window).groupBy("query_id").applyInPandas(run, "query_id long, pos int, row_id long")
    tail = rows.filter(F.col("pos") > window).select(F.col("query_id").cast("long").alias("query_id"), "pos", F.col("row_id").cast("long").alias("row_id"))
    both = head.unionByName(tail)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))


def collapse_titles(rows: DataFrame) -> DataFrame:
    """query_id, pos, row_id: ``collapse`` of all rows, each title that is not empty being a
    query of its own in the order of row_id.  Titles stream through sorted partitions, many
    in a task, and of a title its kept rows alone are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        title, kept, done = None, Kept(), []

        def close() -> None:
            done.extend((query, pos, r["row_id"]) for query, (pos, r) in zip([title[0]] * len(kept.rows), enumerate(kept.rows, 1), strict=True))

        def made() -> pa.RecordBatch:
            query, pos, row = zip(*done, strict=True) if done else ((), (), ())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(pos, pa.int32()), pa.array(row, pa.int64())], names=["query_id", "pos", "row_id"])

        for b in batches:
            for r in b.to_pylist():
                r["pos"] = 0
                now = (r["query_id"], r["normalized_title"])
                if now != title:
                    if title is not None:
                        close()
                    title, kept = now, Kept()
                kept.take(r)
            yield made()
        if title is not None:
            close()
            yield made()

    query = F.xxhash64("normalized_title").alias("query_id")
    needed = rows.filter("normalized_title <> ''").select(query, F.col("row_id").cast("long").alias("row_id"), *_needed(rows))
    return needed.repartition("query_id").sortWithinPartitions("query_id", "normalized_title", "row_id").mapInArrow(run, "query_id long, pos int, row_id long")


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    if not 1 <= limit <= 50 or not 0 <= offset <= 10_000:
        raise ValueError("limit must be 1 to 50, offset 0 to 10,000")
    return rows.filter((F.col("pos") > offset) & (F.col("pos") <= offset + limit))


def counters(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """One row a query: total_matches, shown, has_more, next_offset."""
    total = F.count("*")
    shown = F.count_if((F.col("pos") > offset) & (F.col("pos") <= offset + limit))
    base = rows.groupBy("query_id").agg(total.alias("total_matches"), shown.alias("shown"))
    base = base.withColumn("has_more", (F.col("shown") > 0) & (F.col("total_matches") > offset + F.col("shown")))
    return base.withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset) + F.col("shown")))
