"""Queries over a built index, backfills, ordered scans and evaluation."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vector as V
from lodestone.functions.embed import HashingEmbedder, embedded
from lodestone.operators import backfill, engine, evaluation, ivfpq, search, titles
from lodestone.operators import index as I
from lodestone.operators import papers as P
from lodestone.plans.corpus import _PAPERS, _norm
from lodestone.plans.vectors import _emb, _one
from lodestone.sources import works

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PATCHES = [("W100", {"title": "A title put right", "publication_year": "2011"}, False), ("W200", {}, True), ("W300", {"field": "xx", "is_oa": "true"}, False)]
SUPPLEMENT = {"format_version": 1, "records": [{"work_id": "https://x.example/W900000001", "title": "A work that was left out", "verified_at": "2026-01-02", "sources": ["https://x.example/a"], "publication_year": 2012, "cited_by_count": 5, "field": "en"}]}
_BUILT: dict[tuple, str] = {}
#: Opened once, with its checks, as a service would.
_OPENED: dict[tuple, I.Index] = {}


def _index(spark, d, **more) -> I.Index:
    """The generation of a data folder, built once a session; centroids are vectors 0 to
    15, so that its lists are the same in every run."""
    # A folder whose files are not those of the build is built anew.
    files = I.Files(spark, d)
    at = (spark.sparkContext.applicationId, d, *[files.stamp(f"{d}/{t}.parquet") for t in ("documents", "labels", "embeddings")])
    if at not in _BUILT:
        out = f"{I.scratch(spark)}/index-{uuid.uuid4().hex}"
        centroids = _emb(spark, d).filter("vec_id < 16").select(F.col("vec_id").cast("int").alias("list_id"), F.transform("embedding", lambda x: x.cast("double")).alias("c"))
        I.build(P.papers(spark, d), _emb(spark, d).select("vec_id", "embedding"), out, centroids=centroids)
        _BUILT[at] = out
        patches = spark.createDataFrame(PATCHES, "work_id string, changes map<string,string>, unreliable boolean")
        _OPENED[at] = I.open_index(spark, out, patches=patches, supplement=engine.supplement(SUPPLEMENT))
    return replace(_OPENED[at], **more) if more else _OPENED[at]


#: Papers with the corrections above.
_FIXED = f"""{_PAPERS}, fixed AS (SELECT row_id, work_id,
  CASE WHEN work_id = 'W100' THEN 'A title put right' ELSE title END AS title, normalized_title, snippet,
  CASE WHEN work_id = 'W100' THEN 2011 ELSE publication_year END AS publication_year, cited_by_count,
  CASE WHEN work_id = 'W200' THEN 0 ELSE cited_by_count END AS effective_citations,
  CASE WHEN work_id = 'W300' THEN 'xx' ELSE field END AS field, topic,
  is_oa OR work_id = 'W300' AS is_oa FROM papers)"""


def _asked(index):
    """The stated query set: papers whose id is divisible by 100."""
    return index.table("papers").filter("row_id % 100 = 0 AND normalized_title <> ''").select(F.col("row_id").alias("query_id"), "normalized_title")


@query(f"""WITH {_PAPERS} SELECT row_id, normalized_title FROM papers
WHERE normalized_title <> '' AND normalized_title IN (SELECT normalized_title FROM papers WHERE row_id % 100 = 0)""")
def index_title_lookup(spark, d):
    index = _index(spark, d)
    return index.probe_many("titles", _asked(index).select(F.col("normalized_title").alias("key"))).select("row_id", F.col("key").alias("normalized_title"))


@query(f"""WITH {_PAPERS}, k AS (SELECT DISTINCT array_to_string(string_split(normalized_title, ' ')[1:4], ' ') AS key FROM papers
  WHERE row_id % 100 = 0 AND len(string_split(normalized_title, ' ')) >= 4)
SELECT DISTINCT key AS prefix, row_id FROM papers JOIN k ON starts_with(normalized_title, key || ' ')""")
def index_prefix_lookup(spark, d):
    index = _index(spark, d)
    words = F.split("normalized_title", " ")
    keys = _asked(index).filter(F.size(words) >= 4).select(F.array_join(F.slice(words, 1, 4), " ").alias("key"))
    return index.probe_many("prefixes", keys).select(F.col("key").alias("prefix"), "row_id")


_WORDS = ("the", "and", "of", "in", "to")


def _fts_sql(a: str, b: str) -> str:
    w = "list_filter(string_split(strip_accents(replace(normalized_title, '-', ' ')), ' '), lambda x: x <> '')"
    n = lambda x: f"len(list_filter(w, lambda x: x = '{x}'))"
    part = lambda i: f"ln((docs - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / mean))"
    return f"""(SELECT '{a} {b}' AS query, row_id, round(bm25, 6) AS bm25 FROM (SELECT row_id, cited_by_count, {part(0)} + {part(1)} AS bm25
FROM (SELECT row_id, cited_by_count, len(w) AS n, {n(a)} AS t0, {n(b)} AS t1 FROM (SELECT row_id, cited_by_count, {w} AS w FROM papers)) t,
(SELECT count(*) AS docs, avg(len(w)) AS mean, count_if(list_contains(w, '{a}')) AS d0, count_if(list_contains(w, '{b}')) AS d1 FROM (SELECT {w} AS w FROM papers))
WHERE t0 > 0 AND t1 > 0) ORDER BY round(bm25, 9) DESC, cited_by_count DESC, row_id LIMIT 50)"""


_PAIRS = [(a, b) for i, a in enumerate(_WORDS) for b in _WORDS[i + 1 :]]


@query(f"WITH {_PAPERS} " + " UNION ALL ".join(_fts_sql(a, b) for a, b in _PAIRS))
def fts_index_pairs(spark, d):
    """Every pair of a stated list of words, by the postings of these words alone."""
    index, out = _index(spark, d), None
    for a, b in _PAIRS:
        one = titles.search(index, f"{a} {b}", 50).select(F.lit(f"{a} {b}").alias("query"), "row_id", F.round("bm25", 6).alias("bm25"))
        out = one if out is None else out.unionByName(one)
    return out


_TITLED = f"""WITH {_FIXED}, now AS (SELECT *, {_norm('title')} AS own FROM fixed),
k AS (SELECT DISTINCT normalized_title AS key FROM papers WHERE row_id % 100 = 0 AND normalized_title <> ''),
p AS (SELECT DISTINCT array_to_string(string_split(key, ' ')[1:3], ' ') AS key FROM k WHERE len(string_split(key, ' ')) > 3)"""
_PASS = "is_oa AND publication_year > 0 AND publication_year >= 1995"


@query(f"""{_TITLED} SELECT row_id, effective_citations AS citations FROM now WHERE own IN (SELECT key FROM k) ORDER BY effective_citations DESC, row_id LIMIT 100""")
def index_exact_rows(spark, d):
    """The most cited papers of any of the stated titles, corrections counted."""
    index = _index(spark, d)
    keys = _asked(index).select(F.col("normalized_title").alias("key"))
    return titles.most_cited_of(index, "titles", keys, P.Filters(), engine.TITLE_ROWS)


@query(f"""{_TITLED} SELECT row_id, effective_citations AS citations FROM now WHERE {_PASS} AND EXISTS (SELECT 1 FROM p WHERE starts_with(own, p.key || ' ')) ORDER BY effective_citations DESC, row_id LIMIT 50""")
def index_prefix_rows(spark, d):
    """The most cited papers behind any of the stated prefixes that pass the filters."""
    index = _index(spark, d)
    words = F.split("normalized_title", " ")
    keys = _asked(index).filter(F.size(words) > 3).select(F.array_join(F.slice(words, 1, 3), " ").alias("key"))
    return titles.most_cited_of(index, "prefixes", keys, P.Filters(is_oa=True, year_min=1995), engine.PREFIX_ROWS)


@query(f"""WITH {_FIXED} SELECT work_id, title, publication_year, effective_citations FROM fixed WHERE work_id IN ('W3', 'W100', 'W200')
UNION ALL SELECT 'W900000001', 'A work that was left out', 2012, 5""")
def work_lookup(spark, d):
    found = engine.lookup(_index(spark, d), ["https://x.example/w3/", "W100?a", " w200#t ", "W999999999", "w900000001"])
    return found.select("work_id", "title", "publication_year", F.col("effective_citations").cast("long").alias("effective_citations"))


@query(f"""WITH {_FIXED}, a AS (SELECT * FROM (VALUES ('w3', 'W3'), ('https://x.example/W100/?a', 'W100'), ('W999999999', 'W999999999'), ('no id', ''), ('W900000001', 'W900000001')) t(value, work_id)),
r AS (SELECT work_id, title FROM fixed UNION ALL SELECT 'W900000001', 'A work that was left out')
SELECT value, a.work_id, CASE WHEN title IS NOT NULL THEN 'found' WHEN a.work_id = '' THEN 'no id' ELSE 'not found' END AS status, title FROM a LEFT JOIN r ON r.work_id = a.work_id""")
def work_lookup_status(spark, d):
    """Every asked id has its answer, also one that is not there and one that is no id."""
    return engine.looked_up(_index(spark, d), ["w3", "https://x.example/W100/?a", "W999999999", "no id", "W900000001"]).select("value", "work_id", "status", "title")


@query(f"WITH {_FIXED} SELECT row_id, work_id, title FROM fixed WHERE row_id IN (1, 100, 150)")
def fetch_rows(spark, d):
    return _index(spark, d).fetch([1, 100, 150, -4, 10**12]).select("row_id", "work_id", "title")


@query(f"WITH {_PAPERS} SELECT row_id FROM papers WHERE publication_year BETWEEN 2001 AND 2003")
def year_range_ids(spark, d):
    return _index(spark, d).all_year_ids(2001, 2003)


_FILTER = "publication_year > 0 AND publication_year >= 2000 AND effective_citations >= 300 AND is_oa"


@query(f"WITH {_FIXED} SELECT row_id, effective_citations, publication_year FROM fixed WHERE {_FILTER}")
def corrected_filter(spark, d):
    filters = P.Filters(year_min=2000, min_citations=300, is_oa=True)
    return _index(spark, d).papers.filter(filters.column("effective_citations")).select("row_id", F.col("effective_citations").cast("long").alias("effective_citations"), "publication_year")


@query(f"WITH {_FIXED} SELECT row_id FROM fixed WHERE publication_year > 0 AND publication_year <= 2001 ORDER BY row_id")
def eligible_ids(spark, d):
    return _index(spark, d).papers.filter(P.Filters(year_max=2001).column("effective_citations")).select("row_id").orderBy("row_id")


@query(f"""WITH {_FIXED} SELECT row_id, rank FROM (SELECT row_id, (row_id * 7919) % 1009 AS rank FROM fixed WHERE is_oa)""")
def filter_in_order(spark, d):
    index = _index(spark, d)
    ranked = index.table("papers").select("row_id", ((F.col("row_id") * 7919) % 1009).alias("rank"))
    return engine.in_order(ranked, index, P.Filters(is_oa=True)).orderBy("rank")


@query(f"""WITH {_FIXED}, a AS (SELECT count_if(is_oa) AS n FROM fixed), b AS (SELECT count_if(field = 'nowhere') AS n FROM fixed)
SELECT CAST(a.n AS BIGINT) AS open_access, CAST(b.n AS BIGINT) AS nowhere, CAST(0 AS BIGINT) AS both_parts, CAST(2 AS INTEGER) AS scans FROM a, b""")
def filter_count_cache(spark, d):
    """Counts that are kept: the conjunction needs no scan, as one part matches nothing."""
    counts = engine.FilterCounts(_index(spark, d))
    a, b = counts.count(P.Filters(is_oa=True)), counts.count(P.Filters(field="nowhere"))
    both = counts.count(P.Filters(is_oa=True, field="nowhere"))
    counts.count(P.Filters(is_oa=True))
    return spark.createDataFrame([(a, b, both, counts.scans)], "open_access long, nowhere long, both_parts long, scans int")


_CODES = f"""held AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS v FROM embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)),
x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM held),
s AS (SELECT pos, CASE WHEN max(abs(x)) < 1.1920928955078125e-07 THEN 1.0 ELSE max(abs(x)) / 127 END AS scale FROM x GROUP BY pos),
z AS (SELECT vec_id, list(round_even(least(greatest(x / scale, -127.0), 127.0), 0) * scale ORDER BY x.pos) AS v FROM x JOIN s ON x.pos = s.pos GROUP BY vec_id),
sem AS (SELECT z.vec_id AS row_id, list_cosine_similarity(z.v, q.v) AS sem FROM z, (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) q)"""


@query(f"WITH {_FIXED}, {_CODES} SELECT row_id, round(sem, 6) AS sem FROM sem JOIN fixed USING (row_id) WHERE {_FILTER}")
def candidates_exact(spark, d):
    """Every paper that matches is scored from its codes, corrections counted."""
    found = engine.scored_eligible(_index(spark, d), _one(spark, d), P.Filters(year_min=2000, min_citations=300, is_oa=True))
    return found.select("row_id", F.round("sem", 6).alias("sem"))


@query(f"WITH {_FIXED}, {_CODES} SELECT row_id, round(sem, 6) AS sem FROM sem JOIN fixed USING (row_id) WHERE is_oa ORDER BY round(sem, 9) DESC, row_id LIMIT 40")
def candidates_widened(spark, d):
    """Too many match for the exact path: one list is asked, and then all."""
    # More candidates are asked for than there are vectors, so that none is cut off.
    tuning = I.Tuning(candidates=10**6, filter_candidates=40, nprobe=1, filter_nprobe=16, selective=1)
    found, _ = engine.semantic_candidates(_index(spark, d, tuning=tuning), _one(spark, d), P.Filters(is_oa=True))
    return found.select("row_id", F.round("sem", 6).alias("sem"))


_PQ: dict[tuple, str] = {}


def _pq_index(spark, d) -> I.Index:
    """The same papers with product codes, trained on their vectors, in shards of 500."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _PQ:
        out = f"{I.scratch(spark)}/pq-{uuid.uuid4().hex}"
        n = _emb(spark, d).count()
        I.build(P.papers(spark, d), _emb(spark, d).select("vec_id", "embedding"), out, pq=ivfpq.Settings(max(1, n // 40), parts=16), shard_rows=500)
        _PQ[at] = out
    return I.open_index(spark, _PQ[at])


def _truth(spark, d):
    """The stated truth rows (query_id, query): each seventh vector of a paper."""
    rows = _emb(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return rows.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("query"))


@query("SELECT count(*) AS queries, true AS pool_reaches, true AS best_reaches FROM embeddings WHERE vec_id % 7 = 0 AND vec_id IN (SELECT doc_id FROM documents)")
def pq_recall_at_20(spark, d):
    """Over all truth rows, through the index in one job: whether the mean recall of the pool
    from product codes, and of its best by INT8 codes, is 0.95 or more."""
    # These vectors have no groups, so that most lists must be asked (README).
    report = engine.recall_over_truth(_pq_index(spark, d), _truth(spark, d), _emb(spark, d), nprobe=10**4, pool=200)
    least = F.lit(evaluation.LEAST_RECALL)
    return report.select("queries", (F.col("pool_mean") >= least).alias("pool_reaches"), (F.col("mean") >= least).alias("best_reaches"))


@query()
def pq_grid(spark, d):
    """Recall of the pool by nprobe and size, over all truth rows, in one job."""
    return engine.grid(_pq_index(spark, d), _truth(spark, d), _emb(spark, d), (8, 16, 32, 64), (20, 100, 300))


@query()
def search_page(spark, d):
    """A whole search: title, prefix, semantic and supplement candidates, one page."""
    index = _index(spark, d)
    row = index.fetch([5]).select("title").first()
    found = engine.search(index, row["title"] or "untitled", _one(spark, d))
    return found.page.select("pos", "row_id", F.round("score", 6).alias("score"), "exact", "title", "publication_year")


@query()
def hybrid_search(spark, d):
    """A typed title and a vector against the built index."""
    index = _index(spark, d)
    return engine.search(index, "a work that was left out", _one(spark, d), sort="relevance").page.select("pos", "row_id", "work_id", "title", "publication_year", "cited_by_count")


@query(f"""WITH {_PAPERS} SELECT publication_year AS year, n - CASE WHEN publication_year = 100 % 35 + 1990 THEN 1 ELSE 0 END + CASE WHEN publication_year = 2011 THEN 1 ELSE 0 END AS papers, true AS kept_to
FROM (SELECT publication_year, count(*) AS n FROM papers GROUP BY publication_year ORDER BY n, publication_year LIMIT 1)""")
def selective_filter_check(spark, d):
    index = _index(spark, d)
    year, n, right = evaluation.selective_check(index, "any words", _one(spark, d))
    return spark.createDataFrame([(year, n, right)], "year int, papers long, kept_to boolean")


@query(f"""WITH {_PAPERS} SELECT row_id, true AS found FROM papers WHERE row_id IN (1, 2, 3) AND normalized_title <> ''""")
def title_probes(spark, d):
    index = _index(spark, d)
    titles = index.fetch([1, 2, 3]).filter("normalized_title <> ''").select("row_id", "title").collect()
    probes = [(r["row_id"], evaluation.title_probe(index, r["title"], _one(spark, d))[0]) for r in titles]
    return spark.createDataFrame(probes, "row_id long, found boolean")


@query("""SELECT event_type, count(*) AS requests, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def latency_summary(spark, d):
    out = evaluation.latency_summary(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value")
    return out.select("event_type", "requests", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean")])


@query("SELECT event_type AS error, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type")
def errors_by_name(spark, d):
    runs = spark.read.parquet(f"{d}/events.parquet").select(F.when(F.col("value") > 50, F.col("event_type")).alias("error"))
    return evaluation.errors_by_name(runs)


@query("""WITH r AS (SELECT vec_id AS query_id, label + 1 AS a, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE (label * 3) % 10 + 1 END AS b FROM embeddings)
SELECT query_id, CASE WHEN b IS NULL OR a < b THEN 'better' WHEN a > b THEN 'worse' ELSE 'same' END AS change FROM r""")
def compare_with_baseline(spark, d):
    e = _emb(spark, d).select(F.col("vec_id").alias("query_id"), "label")
    before = e.filter("query_id % 4 <> 0").select("query_id", ((F.col("label") * 3) % 10 + 1).alias("rank"))
    return evaluation.compare_runs(e.select("query_id", (F.col("label") + 1).alias("rank")), before)


@query("SELECT source AS value, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT source FROM documents)")
def field_dictionary(spark, d):
    return evaluation.dictionary(spark.read.parquet(f"{d}/documents.parquet"), "source")


@query("SELECT vec_id, round(sqrt(list_inner_product(v, v)), 9) AS norm, round(v[1] / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END, 9) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def unit_vectors(spark, d):
    e = _emb(spark, d).select("vec_id", "embedding", V.normalize(F.col("embedding")).alias("unit"))
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 9).alias("norm"), F.round(F.col("unit")[0], 9).alias("first"))


_SURNAME = _norm("strip_accents(coalesce(authors[1], ''))")


@query(f"""WITH {_PAPERS} SELECT row_id, regexp_replace(lower(doi), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '') AS doi,
coalesce(list_last(string_split({_SURNAME}, ' ')), '') AS surname FROM papers""")
def doi_and_surname(spark, d):
    return P.papers(spark, d).select("row_id", X.doi(F.col("doi")).alias("doi"), X.surname(F.col("authors")).alias("surname"))


@query(f"WITH {_PAPERS} SELECT row_id, row_id AS number, coalesce(nullif(doi, ''), 'https://x.example/' || work_id) AS view_url FROM papers")
def result_cards(spark, d):
    rows = P.papers(spark, d).withColumn("work_url", F.concat(F.lit("https://x.example/"), "work_id"))
    return works.card(rows).select("row_id", X.numeric_id(F.col("work_url")).alias("number"), "view_url")


@query("""SELECT file_rank, line, doc_id FROM (SELECT 3 - doc_id % 4 AS file_rank, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1 AS line, doc_id FROM documents)
WHERE file_rank > 1 OR (file_rank = 1 AND line >= 20)""")
def newest_first_scan(spark, d):
    """Four files of JSON lines, read newest name first, from a cursor on."""
    path = f"{I.scratch(spark)}/lines-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("doc_id") % 4).alias("part"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select(F.to_json(F.struct("doc_id")).alias("value"), "part").write.partitionBy("part").text(path)
    rows = works.resume(works.ordered_scan(spark, path), 1, 20)
    return rows.select("file_rank", "line", F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"))


@query("""SELECT file, line FROM (SELECT l_suppkey % 40 AS file, row_number() OVER (PARTITION BY l_suppkey % 40 ORDER BY l_orderkey, l_linenumber) - 1 AS line FROM lineitem)
WHERE line < CAST(ceil(3 * 1000.0 / (SELECT count(DISTINCT l_suppkey % 40) FROM lineitem)) AS INTEGER)""")
def weighted_sample_lines(spark, d):
    """No more files than are wanted, so that all are taken; the first lines of each."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("file", F.col("l_suppkey") % 40)
    lines = rows.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("l_orderkey", "l_linenumber")) - 1).alias("line"))
    return works.sampled_lines(lines, rows.groupBy("file").agg(F.count("*").alias("record_count")), 1000)


@query("""SELECT id, source_rank FROM (SELECT id, source_rank, row_number() OVER (PARTITION BY id ORDER BY source_rank, line) AS n FROM (
SELECT doc_id AS id, 0 AS source_rank, doc_id AS line FROM documents WHERE doc_id < 5 UNION ALL SELECT doc_id, 1, doc_id FROM documents)) WHERE n = 1""")
def seed_overlay(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit(0).alias("file_rank"), F.col("doc_id").alias("line"))
    return works.overlay(docs.filter("id < 5"), docs).select("id", "source_rank")


@query("""SELECT user_id AS id, event_id AS line FROM (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id) ORDER BY event_id LIMIT 200""")
def usable_papers(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id"), F.lit(0).alias("file_rank"), F.col("event_id").alias("line"))
    return works.usable(rows, 200).select("id", "line")


@query("""WITH f AS (SELECT 'part-' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS url, count(*) AS n FROM lineitem GROUP BY l_suppkey)
SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS records, sha256(string_agg(url || ' ' || n, chr(10) ORDER BY url)) AS identity FROM f""")
def snapshot_identity(spark, d):
    files = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.concat(F.lit("part-"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("url")).agg(F.count("*").alias("record_count"))
    return backfill.snapshot_identity(files)


@query(f"""SELECT 'D' || doc_id AS work_id, {_norm("string_split(coalesce(text, ''), chr(10))[1]")} AS normalized_title, source AS topic, n_chars AS cited_by_count, CAST(0 AS INTEGER) AS publication_year
FROM documents WHERE trim(regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '\\s+', ' ', 'g')) <> ''""")
def custom_corpus(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select(F.concat(F.lit("D"), "doc_id").alias("id"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), F.col("source").alias("category"), F.col("n_chars").alias("popularity"))
    rows = rows.filter(X.clean(F.col("title")) != "")
    return works.custom_corpus(rows).select("work_id", "normalized_title", "topic", "cited_by_count", "publication_year")


_SHARDED = """l AS (SELECT vec_id % 3 AS shard, vec_id AS line, vec_id AS id FROM embeddings UNION ALL SELECT 2, 1000000000 + vec_id, vec_id FROM embeddings WHERE vec_id % 5 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shard, line) AS n FROM l),
p AS (SELECT shard, id, row_number() OVER (PARTITION BY shard ORDER BY line) - 1 AS pos, row_number() OVER (ORDER BY shard, line) - 1 AS row_id FROM f WHERE n = 1)"""


def _backfilled(spark, d) -> str:
    """Three shards with repeats; the first run ends after one, and leaves half a shard."""
    out = f"{I.scratch(spark)}/backfill-{uuid.uuid4().hex}"
    e = _emb(spark, d).select("vec_id", "embedding")
    rows = e.select((F.col("vec_id") % 3).cast("int").alias("shard"), F.col("vec_id").alias("line"), F.col("vec_id").alias("id"), "embedding")
    rows = rows.unionByName(e.filter("vec_id % 5 = 0").select(F.lit(2).alias("shard"), (F.col("vec_id") + 1_000_000_000).alias("line"), F.col("vec_id").alias("id"), "embedding"))
    settings = {"dim": 64, "stride": 7}
    # One vector bounds the codes of all shards, so that no later one is clipped.
    widest = e.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg((F.max(F.abs("x").cast("double")) / 127).alias("s")).orderBy("pos")
    I.Files(spark, out).write(f"{out}/scales.json", json.dumps([r["s"] for r in widest.collect()]))
    backfill.run(rows, out, settings=settings, snapshot=lambda: "one", shards=3, stop_after=1)
    rows.filter("shard = 1").limit(3).select("id", "line").write.parquet(f"{out}/shards/shard=1")
    backfill.run(rows, out, settings=settings, snapshot=lambda: "one", shards=3)
    return out


@query(f"WITH {_SHARDED} SELECT CAST(shard AS INTEGER) AS shard, pos, id, pos % 7 = 0 AS truth FROM p")
def backfill_resumed(spark, d):
    out = _backfilled(spark, d)
    return spark.read.parquet(f"{out}/shards").select("shard", F.col("pos").cast("long").alias("pos"), "id", "truth")


@query(f"WITH {_SHARDED} SELECT row_id, id FROM p WHERE pos % 7 = 0")
def assembled_truth_rows(spark, d):
    rows = backfill.assemble(spark, _backfilled(spark, d), shards=3)
    return backfill.truth_rows(rows.filter("truth"), rows).select("row_id", "id")


@query()
def table_checksums(spark, d):
    return backfill.checksums(spark, f"{d}/documents.parquet")


@query()
def hash_embed_topk(spark, d):
    """Nearest documents by hashed words, over whole texts."""
    docs = embedded(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), HashingEmbedder(64)).select("doc_id", "embedding")
    ask = docs.filter("doc_id = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.topk_batch(docs, ask, 20, vec_id="doc_id")


@query(f"""WITH {_PAPERS}, n AS (SELECT count(*) AS n FROM papers) SELECT n AS records,
CAST(least(greatest(floor(4 * sqrt(n)), 16), 131072) AS INTEGER) AS lists, CAST(greatest(8, floor(least(greatest(floor(4 * sqrt(n)), 16), 131072) / 8)) AS INTEGER) AS nprobe FROM n""")
def index_sizes(spark, d):
    n = _index(spark, d).records
    return spark.createDataFrame([(n, I.list_count(n), I.probe_count(I.list_count(n)))], "records long, lists int, nprobe int")


@query(f"WITH {_PAPERS} SELECT count(*) AS records, CAST(count_if(is_oa) AS BIGINT) AS open_access, CAST(16 AS INTEGER) AS lists, (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) AS vectors FROM papers")
def describe_generation(spark, d):
    return engine.describe(_index(spark, d)).select("records", "open_access", "lists", "vectors")
