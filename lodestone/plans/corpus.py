"""Queries over the papers model: filters, lookups, corrections, ranking, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vector as V
from lodestone.operators import papers as P
from lodestone.operators import ranking as R
from lodestone.operators.numbering import numbered
from lodestone.plans.vectors import _emb, _one

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add




def _norm(t: str) -> str:
    """A title's key in SQL, by its expression."""
    return f"array_to_string(regexp_extract_all({X.casefold_sql(t)}, '[\\p{{L}}\\p{{N}}_-]+'), ' ')"


_PAPERS = f"""papers AS (SELECT row_id, 'W' || row_id AS work_id, title, {_norm('title')} AS normalized_title, snippet,
 CAST(row_id % 35 + 1990 AS INTEGER) AS publication_year, n_chars AS cited_by_count, source AS topic, lang AS field, coalesce(quality = 1, false) AS is_oa,
 CASE WHEN row_id % 3 = 0 THEN 'https://doi.org/10.5/P' || row_id % 97 ELSE '' END AS doi, CASE WHEN row_id % 5 = 0 THEN [] ELSE ['Ann É. Óname' || row_id % 7] END AS authors
 FROM (SELECT d.doc_id AS row_id, string_split(coalesce(text, ''), chr(10))[1] AS title,
 substr(substr(coalesce(text, ''), length(string_split(coalesce(text, ''), chr(10))[1]) + 2), 1, 1500) AS snippet, n_chars, source, lang, l.quality
 FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id))"""
_FILTER = "publication_year > 0 AND publication_year >= 2000 AND publication_year <= 2015 AND cited_by_count >= 500 AND is_oa AND field = 'en'"
FILTERS = P.Filters(year_min=2000, year_max=2015, min_citations=500, is_oa=True, field="en")


@query(f"WITH {_PAPERS} SELECT row_id, normalized_title FROM papers")
def normalized_titles(spark, d):
    return P.papers(spark, d).select("row_id", "normalized_title")


@query(f"WITH {_PAPERS} SELECT row_id, publication_year, cited_by_count, topic FROM papers WHERE {_FILTER}")
def filter_conjunction(spark, d):
    return P.papers(spark, d).filter(FILTERS.column()).select("row_id", "publication_year", "cited_by_count", "topic")


@query(f"WITH {_PAPERS} SELECT count(*) AS n FROM papers WHERE {_FILTER}")
def filter_count(spark, d):
    return P.papers(spark, d).filter(FILTERS.column()).agg(F.count("*").alias("n"))


@query(f"WITH {_PAPERS} SELECT count_if(publication_year > 0 AND publication_year >= 2000) AS part_0, count_if(publication_year > 0 AND publication_year <= 2015) AS part_1, count_if(cited_by_count >= 500) AS part_2, count_if(is_oa) AS part_3, count_if(field = 'en') AS part_4, count_if({_FILTER}) AS all_parts FROM papers")
def filter_parts_one_pass(spark, d):
    return P.count_parts(P.papers(spark, d), FILTERS)


@query("SELECT CASE WHEN n_chars >= 10000 THEN 10000 WHEN n_chars >= 5000 THEN 5000 WHEN n_chars >= 1000 THEN 1000 WHEN n_chars >= 500 THEN 500 WHEN n_chars >= 100 THEN 100 WHEN n_chars >= 50 THEN 50 WHEN n_chars >= 10 THEN 10 ELSE 0 END AS bucket, count(*) AS n FROM documents GROUP BY ALL")
def citation_buckets(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy(X.citation_bucket(F.col("n_chars")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {_PAPERS} SELECT publication_year, count(*) AS n FROM papers WHERE publication_year > 0 GROUP BY publication_year")
def year_histogram(spark, d):
    return P.year_histogram(P.papers(spark, d))


@query(f"WITH {_PAPERS} SELECT publication_year, count(*) AS n FROM papers WHERE publication_year > 0 GROUP BY publication_year ORDER BY n, publication_year LIMIT 1")
def rarest_year(spark, d):
    return P.rarest_year(P.papers(spark, d))


@query(f"WITH {_PAPERS} SELECT publication_year, row_id FROM papers WHERE publication_year IN (SELECT publication_year FROM papers WHERE publication_year > 0 GROUP BY 1 HAVING count(*) <= 28)")
def selective_year_ids(spark, d):
    return P.selective_years(P.papers(spark, d), 28)


@query(f"WITH {_PAPERS} SELECT count(*) AS n, count_if(is_oa) AS open_access, max(cited_by_count) AS most_cited, count(DISTINCT topic) AS topics FROM papers")
def describe_index(spark, d):
    return P.papers(spark, d).agg(F.count("*").alias("n"), F.count_if("is_oa").alias("open_access"), F.max("cited_by_count").alias("most_cited"), F.count_distinct("topic").alias("topics"))


_KEYS = "keys AS (SELECT row_id AS query_id, normalized_title AS key FROM papers WHERE row_id % 50 = 0 AND normalized_title <> '')"


def _keys(rows):
    return rows.filter("row_id % 50 = 0 AND normalized_title <> ''").select(F.col("row_id").alias("query_id"), F.col("normalized_title").alias("key"))


@query(f"WITH {_PAPERS}, {_KEYS} SELECT query_id, row_id, rank FROM (SELECT k.query_id, p.row_id, row_number() OVER (PARTITION BY k.query_id ORDER BY p.cited_by_count DESC, p.row_id) AS rank FROM papers p JOIN keys k ON p.normalized_title = k.key) WHERE rank <= 5")
def exact_title_lookup(spark, d):
    rows = P.papers(spark, d)
    return P.title_lookup(rows, _keys(rows), 5)


@query(f"WITH {_PAPERS}, {_KEYS} SELECT row_id FROM papers WHERE normalized_title IN (SELECT key FROM keys)")
def title_key_exists(spark, d):
    rows = P.papers(spark, d)
    return rows.join(_keys(rows), F.col("normalized_title") == F.col("key"), "left_semi").select("row_id")


_PREFIX = "pre AS (SELECT row_id, array_to_string(w[1:n], ' ') AS prefix, n AS n_words FROM (SELECT row_id, w, unnest(range(3, least(len(w) - 1, 12) + 1)) AS n FROM (SELECT row_id, string_split(normalized_title, ' ') AS w FROM papers)))"


@query(f"WITH {_PAPERS}, {_PREFIX} SELECT prefix, CAST(n_words AS INTEGER) AS n_words, row_id FROM pre")
def title_prefixes(spark, d):
    return P.prefix_index(P.papers(spark, d))


@query(f"WITH {_PAPERS}, {_PREFIX} SELECT prefix, count(*) AS n FROM pre GROUP BY prefix HAVING count(*) > 1")
def prefix_lookup(spark, d):
    return P.prefix_index(P.papers(spark, d)).groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1")


_PKEYS = "pk AS (SELECT row_id AS query_id, array_to_string(string_split(normalized_title, ' ')[1:3], ' ') AS key FROM papers WHERE row_id % 20 = 0 AND len(string_split(normalized_title, ' ')) > 3)"


@query(f"WITH {_PAPERS}, {_PREFIX}, {_PKEYS} SELECT query_id, row_id, rank FROM (SELECT pk.query_id, p.row_id, row_number() OVER (PARTITION BY pk.query_id ORDER BY p.cited_by_count DESC, p.row_id) AS rank FROM pre JOIN pk ON pre.prefix = pk.key JOIN papers p ON p.row_id = pre.row_id) WHERE rank <= 50")
def prefix_rows_top50(spark, d):
    rows = P.papers(spark, d)
    words = F.split("normalized_title", " ")
    keys = rows.filter((F.col("row_id") % 20 == 0) & (F.size(words) > 3)).select(F.col("row_id").alias("query_id"), F.array_join(F.slice(words, 1, 3), " ").alias("key"))
    return P.prefix_rows(rows, keys)


_W = "w AS (SELECT row_id, cited_by_count, list_filter(string_split(replace(normalized_title, '-', ' '), ' '), lambda x: x <> '') AS w FROM papers)"


@query(f"WITH {_PAPERS}, {_W}, st AS (SELECT count(*) AS docs, avg(len(w)) AS mean, count_if(list_contains(w, 'the')) AS d0, count_if(list_contains(w, 'and')) AS d1 FROM w), t AS (SELECT row_id, cited_by_count, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS t0, len(list_filter(w, lambda x: x = 'and')) AS t1 FROM w) SELECT row_id, cited_by_count, round(bm25, 6) AS bm25 FROM (SELECT row_id, cited_by_count, ln((docs - d0 + 0.5) / (d0 + 0.5) + 1) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / mean)) + ln((docs - d1 + 0.5) / (d1 + 0.5) + 1) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / mean)) AS bm25 FROM t, st WHERE t0 > 0 AND t1 > 0 ORDER BY bm25 DESC, cited_by_count DESC, row_id LIMIT 100)")
def fts_and_search(spark, d):
    return P.title_search(P.papers(spark, d), ["the", "and"], 100).withColumn("bm25", F.round("bm25", 6))


@query("SELECT doc_id, CASE WHEN n = '' THEN '' ELSE 'W' || n END AS work_id FROM (SELECT doc_id, regexp_extract(regexp_replace(regexp_replace(trim(u), '[?#].*$', ''), '/+$', ''), '^(?:.*/)?[wW]([0-9]+)$', 1) AS n FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://x.example/w' || doc_id || '/?a=1' WHEN 1 THEN ' W' || doc_id || ' ' WHEN 2 THEN 'https://x.example/A' || doc_id ELSE 'w' || doc_id || '#t' END AS u FROM documents))")
def work_id_normalize(spark, d):
    i = F.col("doc_id").cast("string")
    u = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://x.example/w"), i, F.lit("/?a=1"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" W"), i, F.lit(" "))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("https://x.example/A"), i)).otherwise(F.concat(F.lit("w"), i, F.lit("#t")))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.work_id(u).alias("work_id"))


@query(f"WITH {_PAPERS} SELECT work_id, title, cited_by_count FROM papers WHERE work_id IN ('W3', 'W77', 'W150', 'W999999999')")
def work_id_lookup(spark, d):
    ids = spark.createDataFrame([("https://x.example/w3/",), ("W77?x",), ("w150",), ("W999999999",)], "u string").select(X.work_id(F.col("u")).alias("work_id"))
    return P.papers(spark, d).join(F.broadcast(ids), "work_id", "left_semi").select("work_id", "title", "cited_by_count")


@query(f"WITH {_PAPERS} SELECT work_id, CASE WHEN work_id = 'W1' THEN '' ELSE title END AS title, CASE WHEN work_id = 'W2' THEN 2017 ELSE publication_year END AS publication_year, CASE WHEN work_id = 'W2' THEN false ELSE is_oa END AS is_oa, CASE work_id WHEN 'W1' THEN 'title' WHEN 'W2' THEN 'is_oa,publication_year' WHEN 'W3' THEN 'cited_by_count_unreliable' ELSE '' END AS overridden, CASE WHEN work_id = 'W3' THEN 0 ELSE cited_by_count END AS effective_citations FROM papers")
def overrides_applied(spark, d):
    patches = spark.createDataFrame([("W1", {"title": ""}, False), ("W2", {"publication_year": "2017", "is_oa": "false", "work_id": "W9"}, False), ("W3", {}, True)], "work_id string, changes map<string,string>, unreliable boolean")
    out = P.corrected(P.papers(spark, d), patches)
    return out.select("work_id", "title", "publication_year", "is_oa", F.array_join("overridden_fields", ",").alias("overridden"), F.col("effective_citations").cast("long").alias("effective_citations"))


@query(f"WITH {_PAPERS} SELECT row_id, work_id, title FROM papers UNION ALL SELECT (SELECT max(row_id) FROM papers) + 1, 'X1', 'A record of its own'")
def supplement_merge(spark, d):
    rows = P.papers(spark, d).select("row_id", "work_id", "title")
    extra = spark.createDataFrame([("X1", "A record of its own"), ("W5", "Known already")], "work_id string, title string")
    return P.with_supplement(rows, extra)


_SEM = f"""sem AS (SELECT p.*, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) AS sem FROM papers p JOIN embeddings e ON e.vec_id = p.row_id WHERE p.row_id <> 0),
pool AS (SELECT * FROM sem ORDER BY sem DESC, row_id LIMIT 100),
g AS (SELECT max(sem) - min(sem) AS gap, max(sem) AS top FROM pool),
sp AS (SELECT gap AS spread, CASE WHEN gap = 0 THEN 1.0 ELSE least(greatest(gap / 0.10, 0.25), 2.0) END AS scale, top - 0.5 * gap AS floor FROM g),
fl AS (SELECT s.*, s.normalized_title = (SELECT normalized_title FROM papers WHERE row_id = 5) AS exact FROM sem s WHERE s.row_id IN (SELECT row_id FROM pool) OR s.normalized_title = (SELECT normalized_title FROM papers WHERE row_id = 5)),
rk AS (SELECT 0 AS query_id, fl.*, sp.scale, sp.floor, (fl.sem + (least(ln(1 + fl.cited_by_count) / ln(100001), 1) * 0.15 + least(greatest((fl.publication_year - 1950) / 100.0, 0), 1) * 0.03) * sp.scale + CASE WHEN fl.exact THEN 1.0 ELSE 0.0 END) AS score FROM fl, sp)"""


def _candidates(spark, d):
    """Semantic top 100 of vector 0 (its own row left out), united with the rows titled like row 5."""
    rows = P.papers(spark, d)
    q = V.literal(_one(spark, d))
    sem = rows.join(_emb(spark, d).select(F.col("vec_id").alias("row_id"), F.round(V.cosine(F.col("embedding"), q), 9).alias("sem")), "row_id").filter("row_id <> 0")
    pool = sem.orderBy(F.desc("sem"), "row_id").limit(100)
    found = rows.filter("row_id = 5").select("normalized_title").first()
    exact = F.col("normalized_title") == F.lit(found["normalized_title"] if found else None)
    both = sem.filter(exact).unionByName(pool).dropDuplicates(["row_id"])
    flags = both.withColumns({"exact": F.coalesce(exact, F.lit(False)), "prefix": F.lit(False), "matched": F.lit(False), "query_id": F.lit(0)})
    return pool, R.ranked(flags, pool)


@query(f"WITH {_PAPERS}, {_SEM} SELECT round(spread, 6) AS spread, round(scale, 6) AS scale, round(floor, 6) AS floor FROM sp")
def score_spread(spark, d):
    return R.spread(_candidates(spark, d)[0]).select(*[F.round(c, 6).alias(c) for c in ("spread", "scale", "floor")])


@query(f"WITH {_PAPERS}, {_SEM} SELECT row_id, sem, exact, round(score, 6) AS score FROM rk")
def ranking_score(spark, d):
    return _candidates(spark, d)[1].select("row_id", "sem", "exact", F.round("score", 6).alias("score"))


_ORDER = {
    "relevance": "CASE WHEN exact THEN 0 ELSE 1 END, CASE WHEN exact THEN cited_by_count END DESC NULLS LAST, round(score, 9) DESC, cited_by_count DESC, row_id",
    "most_cited": "cited_by_count DESC, round(score, 9) DESC, row_id",
    "newest": "CASE WHEN publication_year > 0 THEN 0 ELSE 1 END, publication_year DESC, round(score, 9) DESC, row_id",
    "oldest": "CASE WHEN publication_year > 0 THEN 0 ELSE 1 END, publication_year, round(score, 9) DESC, row_id",
}


def _pos(sort: str) -> str:
    keep = "" if sort == "relevance" else " WHERE exact OR sem >= floor"
    return f"WITH {_PAPERS}, {_SEM}, ps AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER[sort]}) AS pos FROM rk{keep})"


for _sort in R.SORTS:

    def _sorted(spark, d, sort=_sort):
        return R.positions(_candidates(spark, d)[1], sort).select("row_id", "pos", F.round("score", 6).alias("score"))

    QUERIES[f"sort_{_sort}"] = _sorted
    SQL[f"sort_{_sort}"] = f"{_pos(_sort)} SELECT row_id, pos, round(score, 6) AS score FROM ps"


@query(f"{_pos('relevance')} SELECT row_id, pos, round(score - CASE WHEN pos <= 40 AND trim(coalesce(snippet, '')) = '' THEN 0.03 * scale ELSE 0 END, 6) AS score FROM ps")
def title_only_penalty(spark, d):
    return R.penalised(R.positions(_candidates(spark, d)[1])).select("row_id", "pos", F.round("score", 6).alias("score"))


@query(f"{_pos('most_cited')} SELECT row_id, pos FROM ps WHERE pos > 5 AND pos <= 10")
def page_2(spark, d):
    return R.page(R.positions(_candidates(spark, d)[1], "most_cited"), 5, 5).select("row_id", "pos")


@query(f"{_pos('most_cited')}, c AS (SELECT query_id, count(*) AS total_matches, count_if(pos > 5 AND pos <= 10) AS shown FROM ps GROUP BY query_id) SELECT query_id, total_matches, shown, shown > 0 AND total_matches > 5 + shown AS has_more, CASE WHEN shown > 0 AND total_matches > 5 + shown THEN 5 + shown END AS next_offset FROM c")
def page_counters(spark, d):
    return R.counters(R.positions(_candidates(spark, d)[1], "most_cited"), 5, 5)


@query()
def dedupe_same_work(spark, d):
    """All papers, one query a title: repeats of a work are dropped at any place."""
    rows = P.papers(spark, d).withColumn("citations", F.col("cited_by_count"))
    # Works without a title are none of each other; they are numbered by ranges.
    blank = numbered(rows.filter("normalized_title = ''").select("row_id"), "row_id", name="n")
    blank = blank.select(F.xxhash64(F.lit("")).alias("query_id"), (F.col("n") + 1).cast("int").alias("pos"), "row_id")
    return R.collapse_titles(rows).unionByName(blank)
