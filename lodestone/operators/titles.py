"""Titles of a generation: impact-ordered lists by title and by prefix, and word postings.

``titles`` and ``prefixes`` hold one row for each paper and key, with the fields that
filters read, so that a lookup never touches ``papers``.  They are bucketed by the key
with hyphens as blanks: one lookup finds a key in all its hyphenated spellings.  Inside a
bucket rows lie by key and then by falling citations; ``level`` is the whole logarithm
of the citations, and ``levels`` counts rows by key and level.  A lookup reads from the
highest level down to where enough rows are expected, and goes on until enough rows
passed the filters or none are left.  So its result is that of a full sort, whatever the
filters, and a key of many rows is not read to its end.

``words`` holds each word's number of titles; ``postings`` its titles with the places
of the word, bucketed by word.  A search for several words starts from the rarest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import papers as P

if TYPE_CHECKING:
    from lodestone.operators.index import Index

#: Fields of a paper that filters read.
FIELDS = ("cited_by_count", "publication_year", "is_oa", "topic", "field")
#: Most spellings that a typed title is looked up by, fewest hyphens first, and most
#: words of a title that is respelled.
SPELLINGS, SPELLED_WORDS = 8, 16
#: Titles of the rarest word up to which they are broadcast.
BROADCAST_TITLES = 200_000
K1, B = 1.2, 0.75


def plain(key: str) -> str:
    """A key with hyphens as blanks."""
    return " ".join(key.replace("-", " ").split())


def plain_column(key: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(key, F.lit("-"), F.lit(" ")), " +", " "))


def level(citations: Column) -> Column:
    """The whole logarithm of citations, to base 2: monotone in them."""
    return F.floor(F.log2(F.greatest(citations, F.lit(0)).cast("double") + 1)).cast("int")


def title_rows(papers: DataFrame) -> DataFrame:
    """(plain, key, level, row_id, the filters' fields) of titles that are not empty."""
    key = F.col("normalized_title")
    return papers.filter(key != "").select(plain_column(key).alias("plain"), key.alias("key"), level(F.col("cited_by_count")).alias("level"), "row_id", *FIELDS)


def prefix_rows(papers: DataFrame) -> DataFrame:
    """The same of each proper prefix of 3 to 12 words."""
    rows = papers.select(F.explode(X.prefixes(F.col("normalized_title"))).alias("key"), "row_id", *FIELDS)
    return rows.select(plain_column(F.col("key")).alias("plain"), "key", level(F.col("cited_by_count")).alias("level"), "row_id", *FIELDS)


def level_rows(rows: DataFrame) -> DataFrame:
    """(plain, key, level, n): how many rows a key has at each level."""
    return rows.groupBy("plain", "key", "level").agg(F.count("*").alias("n"))


def tokens(title: Column) -> Column:
    """Words of a title for postings: hyphens split, accents of Latin letters folded."""
    return F.filter(F.split(F.translate(plain_column(title), X.ACCENTED, X.UNACCENTED), " "), lambda w: w != "")


def word_places(w: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(row, word, its places in order) of each distinct word of each row of a column of
    lists, rows in order: one sort of all words."""
    row, words = pc.list_parent_indices(w).to_numpy().astype(np.int64), pc.list_flatten(w).dictionary_encode()
    if not len(words):
        return row, words.dictionary, pa.array([], pa.list_(pa.int32()))
    code, here = words.indices.to_numpy(), np.arange(len(row))
    place = here - np.maximum.accumulate(np.where(np.concatenate([[True], row[1:] != row[:-1]]), here, 0))
    order = np.lexsort((place, code, row))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(code[order]) != 0) | (np.diff(row[order]) != 0)]))
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
    return row[order][first], words.dictionary.take(words.indices.take(pa.array(order[first]))), places


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of titles (``w``, other columns) a row for each distinct word of each."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            row, words, places = word_places(part.column("w"))
            if len(row):
                own = pa.array(row)
                size = pc.list_value_length(part.column("w")).take(own).cast(pa.int32())
                cols = [words, part.column("row_id").take(own), size, places, *[part.column(c).take(own) for c in FIELDS]]
                yield pa.RecordBatch.from_arrays(cols, names=["word", "row_id", "size", "places", *FIELDS])


def posting_rows(papers: DataFrame) -> DataFrame:
    """(word, row_id, size of the title, places of the word, the filters' fields)."""
    w = papers.select("row_id", *FIELDS, tokens(F.col("normalized_title")).alias("w"))
    kinds = ", ".join(f"{c} {w.schema[c].dataType.simpleString()}" for c in FIELDS)
    return w.mapInArrow(_occurrences, f"word string, row_id {w.schema['row_id'].dataType.simpleString()}, size int, places array<int>, {kinds}")


def gathered(index: Index, keys: list[str]) -> dict[str, dict[str, dict[int, int]]]:
    """For titles and prefixes, the stored keys with the plain form of one of ``keys``, and
    how many rows each has by level; one job for both.  A title has few spellings, and a
    key 63 levels at most."""
    out: dict[str, dict[str, dict[int, int]]] = {"titles": {}, "prefixes": {}}
    plains = sorted({plain(k) for k in keys})
    both = [index.probe(f"{t}_levels", "plain", plains).select(F.lit(t).alias("t"), "key", "level", "n") for t in out]
    for r in both[0].unionByName(both[1]).collect():
        out[r["t"]].setdefault(r["key"], {})[r["level"]] = r["n"]
    return out


def spellings(stored: dict[str, dict[int, int]], key: str) -> list[str]:
    """Stored keys that put hyphens in some of ``key``'s gaps, fewest hyphens first.  The
    index finds them by their common plain form, so none has to be guessed."""
    if not 2 <= len(key.split()) <= SPELLED_WORDS:
        return []
    fits = [s for s in stored if s != key and len(s) == len(key) and all(b == a or (a, b) == (" ", "-") for a, b in zip(key, s, strict=True))]
    return sorted(fits, key=lambda s: (s.count("-"), s))[:SPELLINGS]


def most_cited(index: Index, table: str, keys: list[str], filters: P.Filters, limit: int, stored: dict[str, dict[int, int]] | None = None) -> list[tuple[int, int]]:
    """(effective citations, row_id) of the ``limit`` most cited papers of any of the keys
    that pass the filters; ties to smaller ids.  Corrected papers count with their
    corrected title and fields.  ``stored``: what ``gathered`` found of the table."""
    stored = gathered(index, keys)[table] if stored is None else stored
    counts: dict[int, int] = {}
    for key in set(keys):
        for lv, n in stored.get(key, {}).items():
            counts[lv] = counts.get(lv, 0) + n
    levels = sorted(counts.items(), reverse=True)
    best: list[tuple[int, int]] = []
    wanted, patched = 4 * limit, index.patched
    while levels:
        seen, least = 0, levels[-1][0]
        for lv, n in levels:
            seen += n
            if seen >= wanted:
                least = lv
                break
        rows = index.probe_plain(table, keys).filter(F.col("level") >= least).filter(filters.column("cited_by_count"))
        if patched is not None:
            rows = rows.join(F.broadcast(patched.select("row_id")), "row_id", "left_anti")  # MAX_PATCHES at most
        rows = rows.groupBy("row_id").agg(F.max("cited_by_count").alias("c")).orderBy(F.desc("c"), "row_id").limit(limit)
        best = [(r["c"], r["row_id"]) for r in rows.collect()]
        if len(best) >= limit or least == levels[-1][0]:
            break
        wanted = max(4 * wanted, seen + 1)
    if patched is not None and index.may_be_patched(table, keys):
        own = X.normalize_title(F.col("title"))
        fits = own.isin(keys) if table == "titles" else F.exists(X.prefixes(own), lambda p: p.isin(keys))
        extra = patched.filter(fits).filter(filters.column("effective_citations")).orderBy(F.desc("effective_citations"), "row_id").limit(limit)
        best += [(r["effective_citations"], r["row_id"]) for r in extra.collect()]
    return sorted(best, key=lambda x: (-x[0], x[1]))[:limit]


def most_cited_of(index: Index, table: str, keys: DataFrame, filters: P.Filters, limit: int) -> DataFrame:
    """citations, row_id as of ``most_cited``, for keys of any number in a frame (column
    ``key``): one pass over the table and joins, as literals would be too many for a plan."""
    keys, patched = keys.select("key").distinct(), index.patched
    rows = index.probe_many(table, keys).filter(filters.column("cited_by_count"))
    if patched is not None:
        rows = rows.join(F.broadcast(patched.select("row_id")), "row_id", "left_anti")  # MAX_PATCHES at most
    rows = rows.select("row_id", F.col("cited_by_count").cast("long").alias("citations"))
    if patched is not None:
        own = X.normalize_title(F.col("title"))
        named = F.explode(F.array(own) if table == "titles" else X.prefixes(own)).alias("key")
        now = patched.filter(filters.column("effective_citations")).select("row_id", F.col("effective_citations").cast("long").alias("citations"), named)
        rows = rows.unionByName(now.join(keys, "key", "left_semi").drop("key"))
    best = rows.groupBy("row_id").agg(F.max("citations").alias("citations"))
    return best.select("citations", "row_id").orderBy(F.desc("citations"), "row_id").limit(limit)


def search(index: Index, query: str, limit: int, filters: P.Filters | None = None) -> DataFrame:
    """row_id, cited_by_count, bm25 of titles that hold all words of ``query``; the parts
    of a hyphenated word must stand side by side.  Best first, then most cited, then
    smaller ids.  Reads the buckets of these words alone; titles of generation, before
    corrections."""
    phrases = [[w for w in token.split("-") if w] for token in X.fold_accents(X.plain_key(query)).split()]
    words = list(dict.fromkeys(w for p in phrases for w in p))
    nothing = "row_id long, cited_by_count long, bm25 double"
    if not words:
        return index.spark.createDataFrame([], nothing)
    counts = {r["word"]: r["n"] for r in index.probe("words", "word", words).collect()}
    if len(counts) < len(words):
        return index.spark.createDataFrame([], nothing)
    keep = (filters or P.Filters()).column("cited_by_count")
    rare = min(words, key=lambda w: (counts[w], w))
    rows = index.probe("postings", "word", words).filter(keep)
    if len(words) > 1:
        first = index.probe("postings", "word", [rare]).select("row_id")
        first = F.broadcast(first) if counts[rare] <= BROADCAST_TITLES else first
        rows = rows.join(first, "row_id", "left_semi")
    docs, mean = index.manifest["records"], max(index.manifest["mean_title"], 1e-9)
    idf = F.create_map(*[F.lit(x) for w in words for x in (w, counts[w])])[F.col("word")]
    idf = F.log((F.lit(docs) - idf + 0.5) / (idf + 0.5) + 1)
    tf = F.size("places")
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / mean))
    found = rows.groupBy("row_id").agg(F.first("cited_by_count").alias("cited_by_count"), F.sum(score).alias("bm25"), F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("at"))
    found = found.filter(F.col("n") == len(words))
    for p in phrases:
        on = F.col("at")[p[0]] if p else None
        for w in p[1:]:
            # Places of the phrase so far that the next word follows.
            on = F.array_intersect(F.transform(on, lambda i: i + 1), F.col("at")[w])
        if len(p) > 1:
            found = found.filter(F.size(on) > 0)
    return found.select("row_id", "cited_by_count", "bm25").orderBy(F.desc(F.round("bm25", 9)), F.desc("cited_by_count"), "row_id").limit(limit)
