"""Nested JSON lines to typed rows: scan, parse, latest version wins, samples.

Order is an explicit (file_rank, line) pair, never a physical one, so any plan may
run these steps in parallel and resume from any place.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.index import scratch

SNIPPET_CHARS = 1500
EMBEDDING_CHARS = 2000
AUTHORS = 8
#: Most splits whose counts are broadcast.
MAX_SPLITS = 200_000

RAW = """id string, title string, display_name string, publication_year int,
publication_date string, cited_by_count bigint, doi string, type string, is_expansion boolean,
abstract_inverted_index map<string, variant>,
authorships array<struct<author: struct<display_name: string>>>,
primary_topic struct<display_name: string, field: struct<display_name: string>>,
open_access struct<is_oa: boolean, oa_url: string>,
primary_location struct<landing_page_url: string, source: struct<display_name: string>>"""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzip files with their explicit place: ``value``, ``file`` and
    ``line`` (from 0 in each file, however a plain file is split among tasks).  A first
    reading counts the lines of every split; a line's number is the sum of the splits
    before its own and its place in it, so no task sorts a file.  The second reading has
    the same splits; a line outside its split's count is an error."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_n"))
    splits = raw.groupBy("file", "_start").agg(F.min("_n").alias("_first"), F.count("*").alias("_lines"))  # a row a split
    ahead = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    path = f"{scratch(spark)}/splits-{uuid.uuid4().hex}"
    splits.withColumn("_before", F.coalesce(F.sum("_lines").over(ahead), F.lit(0))).write.parquet(path)
    side = spark.read.parquet(path)
    side = F.broadcast(side) if side.count() <= MAX_SPLITS else side
    at = F.col("_n") - F.col("_first")
    line = F.when((at >= 0) & (at < F.col("_lines")), F.col("_before") + at).otherwise(F.raise_error(F.lit("the files have changed between two readings")).cast("long"))
    return raw.join(side, ["file", "_start"]).select("value", "file", line.alias("line"))


def ordered_scan(spark: SparkSession, path: str) -> DataFrame:
    """(file_rank, line, value): files newest name first.  Tasks may run in any order and
    be tried again; the place is a column, so any later step may resume from it."""
    lines = read_lines(spark, path)
    ranks = newest_first(lines.select("file").distinct(), "file")  # a row a file
    return lines.join(F.broadcast(ranks), "file").select("file_rank", "line", "value")


def abstract(index: Column) -> Column:
    """Words of an inverted index (word to positions) by position; null lists and
    negative positions are left out.  Ties of a position keep the map's order."""
    pairs = F.transform(F.map_entries(index), lambda e, i: F.transform(F.filter(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: p >= 0), lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w"))))
    return F.array_join(F.transform(F.array_sort(F.flatten(pairs)), lambda x: x["w"]), " ")


def parse(lines: DataFrame, *, id_prefix: str, value: str = "value", include_expansion: bool = False) -> DataFrame:
    """Typed works; blank, malformed and non-object lines, foreign ids, works of the
    expansion set and empty titles are left out."""
    # Behind an explode a filter on a field doesn't parse the whole line again.
    raw = lines.select("*", F.explode(F.array(F.from_json(F.col(value), RAW))).alias("_r")).filter(F.col("_r").isNotNull() & F.col("_r.id").isNotNull())
    raw = raw.withColumn("_positions", F.expr("transform_values(coalesce(_r.abstract_inverted_index, cast(map() as map<string, variant>)), (k, v) -> try_variant_get(v, '$', 'array<int>'))"))
    title = F.coalesce(F.nullif(X.clean(F.col("_r.title")), F.lit("")), X.clean(F.col("_r.display_name")))
    names = F.slice(F.filter(F.transform(F.coalesce("_r.authorships", F.array()), lambda a: X.clean(a["author"]["display_name"])), lambda n: n != ""), 1, AUTHORS)
    out = raw.select(
        *[c for c in lines.columns if c != value],
        F.col("_r.id").alias("work_url"),
        X.work_id(F.col("_r.id")).alias("work_id"),
        title.alias("title"),
        X.normalize_title(title).alias("normalized_title"),
        abstract(F.col("_positions")).alias("_abstract"),
        names.alias("authors"),
        F.coalesce("_r.publication_year", F.lit(0)).alias("publication_year"),
        F.greatest(F.coalesce("_r.cited_by_count", F.lit(0)), F.lit(0)).cast("long").alias("cited_by_count"),
        F.coalesce("_r.doi", F.lit("")).alias("doi"),
        X.clean(F.col("_r.primary_topic.display_name")).alias("topic"),
        X.clean(F.col("_r.primary_topic.field.display_name")).alias("field"),
        F.coalesce("_r.open_access.is_oa", F.lit(False)).alias("is_oa"),
        F.coalesce("_r.open_access.oa_url", F.lit("")).alias("oa_url"),
        F.coalesce("_r.type", F.lit("")).alias("work_type"),
        X.clean(F.col("_r.primary_location.source.display_name")).alias("venue"),
        F.coalesce("_r.publication_date", F.lit("")).alias("publication_date"),
        F.coalesce("_r.primary_location.landing_page_url", F.lit("")).alias("landing_url"),
        F.coalesce("_r.is_expansion", F.lit(False)).alias("_expansion"),
    )
    out = out.filter(F.startswith("work_url", F.lit(id_prefix)) & (F.col("title") != ""))
    if not include_expansion:
        out = out.filter(~F.col("_expansion"))
    snippet = F.substring("_abstract", 1, SNIPPET_CHARS)
    embedding = F.substring(F.concat("title", F.lit(". "), "_abstract"), 1, EMBEDDING_CHARS)
    return out.withColumn("snippet", snippet).withColumn("embedding_text", embedding).drop("_abstract", "_expansion")


def view_url(*urls: Column) -> Column:
    """The first non-empty."""
    return F.coalesce(*[F.nullif(u, F.lit("")) for u in urls], F.lit(""))


def newest_first(files: DataFrame, url: str = "url") -> DataFrame:
    """Files of a manifest (a bounded list) with ``file_rank``, newest name first."""
    return files.withColumn("file_rank", F.row_number().over(Window.orderBy(F.desc(url))) - 1)


def first_wins(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def resume(rows: DataFrame, skip_files: int, skip_lines: int) -> DataFrame:
    """Rows from a cursor on: later files, and lines from ``skip_lines`` in its own."""
    at = F.col("file_rank")
    return rows.filter((at > skip_files) | ((at == skip_files) & (F.col("line") >= skip_lines)))


def sample_size(files: int, target: int) -> tuple[int, int]:
    """(files to take, lines of each) for about ``target`` usable records."""
    k = min(files, max(64, min(512, math.ceil(target / 100_000))))
    return k, math.ceil(3 * target / max(k, 1))


def sample_files(files: DataFrame, k: int, weight: str = "record_count", seed: int = 97) -> DataFrame:
    """k files with probability in proportion to their weight, without replacement.  The draw
    is a hash of the seed and the file's name (column ``file``), so it can be repeated."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("file").cast("string")), 256), 1, 12), 16, 10).cast("double")
    key = F.log((drawn + 0.5) / 281474976710656.0) / F.greatest(F.col(weight).cast("double"), F.lit(1e-9))
    return files.withColumn("_k", key).orderBy(F.desc("_k"), "file").limit(k).drop("_k")


def sampled_lines(lines: DataFrame, files: DataFrame, target: int, seed: int = 97) -> DataFrame:
    """The first lines of a weighted sample of files; ``lines`` has file and line."""
    k, most = sample_size(files.count(), target)
    taken = sample_files(files, k, seed=seed).select("file")  # 512 rows at most
    return lines.join(F.broadcast(taken), "file").filter(F.col("line") < most)


def overlay(seed_rows: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Seed rows before all others (``source_rank`` 0 and 1); the first of a key wins."""
    both = seed_rows.withColumn("source_rank", F.lit(0)).unionByName(rows.withColumn("source_rank", F.lit(1)))
    return first_wins(both, key, "source_rank", "file_rank", "line")


def usable(rows: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The first ``limit`` distinct papers in their explicit order."""
    return first_wins(rows, key, "file_rank", "line").orderBy("file_rank", "line").limit(limit)


def custom_corpus(rows: DataFrame) -> DataFrame:
    """A corpus of one's own as papers: ``id`` and ``title`` must not be empty; body, year,
    popularity, category and authors may be missing."""
    bad = rows.filter(F.coalesce(F.trim(F.col("id").cast("string")), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("title"), F.lit("")).eqNullSafe(""))
    if not bad.isEmpty():
        raise ValueError("each row needs an id and a title")
    has = lambda c, otherwise: F.coalesce(F.col(c), otherwise) if c in rows.columns else otherwise
    title = X.clean(F.col("title"))
    return rows.select(
        F.col("id").cast("string").alias("work_id"),
        title.alias("title"),
        X.normalize_title(title).alias("normalized_title"),
        F.substring(X.clean(has("body", F.lit(""))), 1, SNIPPET_CHARS).alias("snippet"),
        has("year", F.lit(0)).cast("int").alias("publication_year"),
        F.greatest(has("popularity", F.lit(0)), F.lit(0)).cast("long").alias("cited_by_count"),
        has("category", F.lit("")).alias("topic"),
        F.slice(has("authors", F.array().cast("array<string>")), 1, AUTHORS).alias("authors"),
    )


def card(rows: DataFrame) -> DataFrame:
    """What a result shows beside its scores: ``work_id`` from the id's last part, and the
    first address there is."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit("")
    return rows.withColumn("view_url", view_url(have("doi"), have("landing_url"), have("oa_url"), have("work_url")))
