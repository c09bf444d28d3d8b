"""The papers model, its filters, lookups, corrections and supplements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X

SNIPPET_CHARS = 1500
EXACT_ROWS = 10_000
MAX_SUPPLEMENT = 500
#: Most corrections that are broadcast.
MAX_PATCHES = 100_000
#: The fields that a correction may patch, by their public names.
PATCHABLE = (
    "title", "snippet", "authors", "publication_year", "publication_date", "doi", "venue", "work_type", "topic",
    "field", "is_oa", "oa_url", "landing_url", "cited_by_count", "cited_by_count_unreliable",
)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` and ``labels`` as papers: the first line is the title, the rest the
    snippet (cut as for a card); language is the field, source the topic.  DOI and
    author come from the id, so that works share some of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    text = F.coalesce("text", F.lit(""))
    first = F.substring_index(text, "\n", 1)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit("W"), F.col("doc_id")).alias("work_id"),
        first.alias("title"),
        X.normalize_title(first).alias("normalized_title"),
        F.substring(F.expr("substring(coalesce(text, ''), length(substring_index(coalesce(text, ''), '\\n', 1)) + 2)"), 1, SNIPPET_CHARS).alias("snippet"),
        (F.col("doc_id") % 35 + 1990).cast("int").alias("publication_year"),
        F.col("n_chars").alias("cited_by_count"),
        F.col("source").alias("topic"),
        F.col("lang").alias("field"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_oa"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.5/P"), F.col("doc_id") % 97)).otherwise("").alias("doi"),
        F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Ann É. Óname"), F.col("doc_id") % 7))).alias("authors"),
    )


@dataclass(frozen=True)
class Filters:
    """A conjunction; a part that is None (or an empty topic or field) is no filter.
    A bound on the year leaves out year 0, which means unknown.  Citations are the
    effective ones where corrections have been applied."""

    year_min: int | None = None
    year_max: int | None = None
    min_citations: int | None = None
    is_oa: bool | None = None
    topic: str | None = None
    field: str | None = None

    @property
    def active(self) -> bool:
        """Any part set, a bound of 0 included."""
        return bool(self.parts())

    def parts(self, citations: str = "cited_by_count") -> list[Column]:
        year, out = F.col("publication_year"), []
        if self.year_min is not None:
            out.append((year > 0) & (year >= self.year_min))
        if self.year_max is not None:
            out.append((year > 0) & (year <= self.year_max))
        if self.min_citations is not None:
            out.append(F.col(citations) >= self.min_citations)
        if self.is_oa is not None:
            out.append(F.col("is_oa") == self.is_oa)
        if self.topic:
            out.append(F.col("topic") == self.topic)
        if self.field:
            out.append(F.col("field") == self.field)
        return out

    def column(self, citations: str = "cited_by_count") -> Column:
        out = F.lit(True)
        for p in self.parts(citations):
            out = out & p
        return out


def count_parts(rows: DataFrame, filters: Filters) -> DataFrame:
    """One pass: rows of each part and of all parts together."""
    parts = filters.parts()
    counts = [F.count_if(p).alias(f"part_{i}") for i, p in enumerate(parts)]
    return rows.agg(*counts, F.count_if(filters.column()).alias("all_parts"))


def year_histogram(rows: DataFrame) -> DataFrame:
    return rows.filter("publication_year > 0").groupBy("publication_year").agg(F.count("*").alias("n"))


def rarest_year(rows: DataFrame) -> DataFrame:
    return year_histogram(rows).orderBy("n", "publication_year").limit(1)


def selective_years(rows: DataFrame, limit: int = EXACT_ROWS) -> DataFrame:
    """(publication_year, row_id) of years with at most ``limit`` rows."""
    years = year_histogram(rows).filter(F.col("n") <= limit).select("publication_year")  # a row a calendar year
    return rows.select("publication_year", "row_id").join(F.broadcast(years), "publication_year")


def _best_of_queries(found: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """For each query of ``keys`` (query_id, key), the most cited of its key's rows.  A key's
    best are found once, however many queries have it."""
    order = [F.desc("cited_by_count"), "row_id"]
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("n") <= limit)
    of_query = Window.partitionBy("query_id").orderBy(*order)
    each = best.join(keys.select("query_id", "key"), "key")
    return each.withColumn("rank", F.row_number().over(of_query)).filter(F.col("rank") <= limit).select("query_id", "row_id", "rank")


def title_lookup(rows: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """For each key (query_id, key), rows of that normalised title, most cited first."""
    found = rows.select("row_id", F.col("normalized_title").alias("key"), "cited_by_count").join(keys.select("key").distinct(), "key")
    return _best_of_queries(found, keys, limit)


def prefix_index(rows: DataFrame) -> DataFrame:
    """(prefix, n_words, row_id), in the order of prefixes when written."""
    out = rows.select("row_id", F.explode(X.prefixes(F.col("normalized_title"))).alias("prefix"))
    return out.select("prefix", F.size(F.split("prefix", " ")).alias("n_words"), "row_id")


def prefix_rows(rows: DataFrame, keys: DataFrame, limit: int = 50) -> DataFrame:
    """Rows whose title goes on after the key, most cited first."""
    hits = prefix_index(rows).join(keys.select("key").distinct(), F.col("prefix") == F.col("key")).select("key", "row_id")
    full = hits.join(rows.select("row_id", "normalized_title", "cited_by_count"), "row_id").filter(F.startswith("normalized_title", F.concat("key", F.lit(" "))))
    return _best_of_queries(full.select("key", "row_id", "cited_by_count"), keys, limit)


def title_search(rows: DataFrame, words: list[str], limit: int) -> DataFrame:
    """Titles holding all words (hyphens split), by BM25, then citations."""
    split = F.filter(F.split(F.replace("normalized_title", F.lit("-"), F.lit(" ")), " "), lambda x: x != "")
    base = rows.select("row_id", "cited_by_count", split.alias("w")).withColumn("n", F.size("w"))
    tf = [F.size("w") - F.size(F.array_remove("w", w)) for w in words]
    stats = base.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.array_contains("w", F.lit(w))).alias(f"df{i}") for i, w in enumerate(words)])
    joined = base.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log((F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        score = score + idf * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("mean")))
    keep = F.lit(True)
    for w in words:
        keep = keep & F.array_contains("w", F.lit(w))
    return joined.filter(keep).select("row_id", "cited_by_count", score.alias("bm25")).orderBy(F.desc("bm25"), F.desc("cited_by_count"), "row_id").limit(limit)


def corrected(rows: DataFrame, patches: DataFrame, small: bool | None = None) -> DataFrame:
    """Patches are (work_id, changes map<string,string>, unreliable): a key's presence
    counts, so a patch may set false or empty.  Only PATCHABLE fields are patched, and
    named in ``overridden_fields``.  An unreliable count counts as 0 in
    ``effective_citations``, which filters, sorts and ranking read; a card keeps the
    published one.  Patches are broadcast only within MAX_PATCHES (``small``: whether they
    are; counted if it is not given)."""
    p = patches.select("work_id", "changes", F.col("unreliable").alias("_unreliable"))
    small = p.limit(MAX_PATCHES + 1).count() <= MAX_PATCHES if small is None else small
    p = F.broadcast(p) if small else p
    joined = rows.join(p, "work_id", "left")
    types = dict(rows.dtypes)
    changes = F.coalesce("changes", F.create_map().cast("map<string,string>"))
    value = lambda c: F.from_json(F.col("changes")[c], types[c]) if types[c].startswith("array") else F.col("changes")[c].cast(types[c])
    fixed = joined.withColumns({c: F.when(F.map_contains_key(changes, c), value(c)).otherwise(F.col(c)) for c in PATCHABLE if c in types})
    named = F.filter(F.array_sort(F.map_keys(changes)), lambda k: k.isin(*PATCHABLE))
    flag = F.coalesce("_unreliable", F.lit(False))
    named = F.when(flag, F.array_sort(F.array_union(named, F.array(F.lit("cited_by_count_unreliable"))))).otherwise(named)
    fixed = fixed.withColumn("overridden_fields", named)
    return fixed.withColumn("effective_citations", F.when(flag, F.lit(0)).otherwise(F.col("cited_by_count"))).drop("changes", "_unreliable")


def with_supplement(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """Add records (work_id, ...) that the corpus lacks, with ids above all others."""
    if extra.limit(MAX_SUPPLEMENT + 1).count() > MAX_SUPPLEMENT:
        raise ValueError(f"a supplement has {MAX_SUPPLEMENT} records at most")
    new = F.broadcast(extra).join(rows.select("work_id"), "work_id", "left_anti")
    top = rows.agg(F.coalesce(F.max("row_id"), F.lit(-1)).alias("top"))
    order = Window.orderBy("work_id")  # a supplement has 500 records at most
    numbered = new.withColumn("_n", F.row_number().over(order)).crossJoin(F.broadcast(top)).withColumn("row_id", F.col("top") + F.col("_n")).drop("_n", "top")
    return rows.unionByName(numbered, allowMissingColumns=True)
