"""Queries over ingest and builds: parsing, versions, resume, logs, streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import builds, titles
from lodestone.operators.index import Files, scratch
from lodestone.sources import works
from lodestone.sources.manifest import ManifestSource
from lodestone.streaming.ingest import ingest

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RAW_WORKS = [
    {"id": "https://x.example/W1", "title": "  First   work ", "abstract_inverted_index": {"deep": [0, 3], "sea": [1], "bad": "x", "minus": [-1, 2]}, "publication_year": 2001, "cited_by_count": 7},
    {"id": "https://x.example/W2", "title": None, "display_name": "Second", "cited_by_count": -4, "authorships": [{"author": {"display_name": " Ann  B "}}, {"author": {"display_name": ""}}]},
    {"id": "https://x.example/W3", "title": "Left out", "is_expansion": True},
    {"id": "https://elsewhere.example/W4", "title": "Foreign"},
    {"id": "https://x.example/W5", "title": ""},
]


_DOC_WORDS = "string_split(coalesce(text, ''), ' ')"


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, n_chars, words): doc_id, n_chars, and the places of each word."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            row, words, places = titles.word_places(part.column("w"))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
            index = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), words, places)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("n_chars").cast(pa.int64()), index], names=["doc_id", "n_chars", "abstract_inverted_index"])


def _manifest_of_documents(spark, d):
    """``documents`` as lines of nested JSON in four files, with lines that are no work, and
    the manifest of these files."""
    base = f"{scratch(spark)}/works-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_chars")
    # A document's index is made where the document lies: no word is shuffled.
    held = docs.select("doc_id", "n_chars", F.split("text", " ").alias("w")).mapInArrow(_inverted, "doc_id long, n_chars long, abstract_inverted_index map<string, array<int>>")
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  Work   "), "doc_id"))
    work = F.struct(F.concat(F.lit("https://x.example/"), F.when(F.col("doc_id") % 11 == 0, "A").otherwise("W"), "doc_id").alias("id"), title.alias("title"), F.concat(F.lit("Other "), "doc_id").alias("display_name"), (F.col("n_chars") - 300).alias("cited_by_count"), (F.col("doc_id") % 13 == 0).alias("is_expansion"), "abstract_inverted_index")
    lines = held.select("doc_id", F.to_json(work).alias("value"))
    odd = docs.filter("doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise('{"id": broken').alias("value"))
    part = (F.col("doc_id") % 4).alias("part")
    lines.unionByName(odd).select("doc_id", "value", part).repartition("part").sortWithinPartitions("part", "doc_id", "value").select("value", "part").write.partitionBy("part").text(f"{base}/lines")
    counts = spark.read.text(f"{base}/lines").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).collect()  # a row a file
    files = Files(spark, base)
    root = files.qualified(f"{base}/lines")
    listed = [{"url": "/".join(r["file"].rsplit("/", 2)[1:]), "meta": {"record_count": r["n"]}} for r in counts]
    files.plain(f"{base}/manifest", json.dumps({"entries": listed}))
    spark.dataSource.register(ManifestSource)
    return spark.read.format("manifest_lines").option("manifest", files.qualified(f"{base}/manifest")).option("root", root).option("lines_per_part", 500).load()


@query(f"""SELECT 'W' || doc_id AS work_id, CASE WHEN doc_id % 3 = 0 THEN 'Work ' || doc_id ELSE 'Other ' || doc_id END AS title,
sha256(substr(array_to_string({_DOC_WORDS}, ' '), 1, 1500)) AS snippet_sha256, greatest(n_chars - 300, 0) AS cited_by_count
FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0""")
def manifest_works(spark, d):
    """All documents as works: read by manifest, parsed, abstracts put together from their
    inverted index."""
    rows = works.parse(_manifest_of_documents(spark, d), id_prefix="https://x.example/W")
    return rows.select("work_id", "title", F.sha2(F.encode("snippet", "UTF-8"), 256).alias("snippet_sha256"), "cited_by_count")


@query("""SELECT 3 - part AS file_rank, row_number() OVER (PARTITION BY part ORDER BY doc_id, odd DESC) - 1 AS line, CASE WHEN odd THEN NULL ELSE doc_id END AS doc_id FROM (
SELECT doc_id, doc_id % 4 AS part, false AS odd FROM documents UNION ALL SELECT doc_id, doc_id % 4, true FROM documents WHERE doc_id % 5 = 0)""")
def manifest_order(spark, d):
    """Every line of the manifest's files with its place, also those that are no work."""
    number = F.nullif(F.regexp_extract("value", r'^\{"id":"https://x.example/[AW]([0-9]+)"', 1), F.lit(""))
    return _manifest_of_documents(spark, d).select(F.col("file_rank").cast("long").alias("file_rank"), "line", number.cast("long").alias("doc_id"))


@query("""WITH b AS (SELECT 'text' AS field, strlen(coalesce(text, '')) AS b FROM documents UNION ALL SELECT 'source', strlen(coalesce(source, '')) FROM documents),
g AS (SELECT field, block_rows, CAST(count(*) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS s FROM b, (SELECT unnest([16, 128, 1024]) AS block_rows) GROUP BY field, block_rows)
SELECT field, block_rows, (n + block_rows - 1) // block_rows AS blocks, s + n - (n + block_rows - 1) // block_rows AS bytes FROM g""")
def block_bytes(spark, d):
    """Blocks of three sizes; compressed sizes are in ``block_compression``."""
    found = builds.block_compression(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", ["text", "source"], [16, 128, 1024])
    return found.select("field", "block_rows", "blocks", "bytes")


@query()
def block_compression(spark, d):
    return builds.block_compression(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", ["text", "source", "lang"], [1, 16, 128, 1024])


@query("SELECT * FROM (VALUES ('W1', 'First work', 'deep sea minus deep', 2001, 7), ('W2', 'Second', '', 0, 0)) t(work_id, title, snippet, publication_year, cited_by_count)")
def abstract_rebuild(spark, d):
    lines = spark.createDataFrame([(json.dumps(x),) for x in RAW_WORKS] + [("",), ("{broken",), ("[1, 2]",)], "value string")
    return works.parse(lines, id_prefix="https://x.example/W").select("work_id", "title", "snippet", "publication_year", F.col("cited_by_count").cast("int").alias("cited_by_count"))


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def latest_wins_dedupe(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return works.first_wins(events, "user_id", F.desc("ts"), "event_id").select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, file_rank, line FROM (SELECT event_id, event_id % 4 AS file_rank, event_id // 4 AS line FROM events) WHERE file_rank > 1 OR (file_rank = 1 AND line >= 100)")
def cursor_resume(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 4).alias("file_rank"), F.expr("event_id div 4").alias("line"))
    return works.resume(rows, 1, 100)


@query("""SELECT file, record_count FROM (SELECT l_suppkey AS file, count(*) AS record_count FROM lineitem GROUP BY l_suppkey)
ORDER BY ln((CAST('0x' || sha256('97:' || file)[1:12] AS BIGINT) + 0.5) / 281474976710656.0) / record_count DESC, file LIMIT 64""")
def weighted_file_sample(spark, d):
    files = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("file")).agg(F.count("*").alias("record_count"))
    return works.sample_files(files, 64)


_MARKER_SQL = """k AS (SELECT CAST(l_suppkey % 40 AS INTEGER) AS shard, count(*) AS records FROM lineitem GROUP BY ALL),
m AS (SELECT shard, CASE WHEN shard % 9 < 6 THEN 'a' ELSE 'b' END AS config, records, CAST(sum(records) OVER (ORDER BY shard) AS BIGINT) AS records_done FROM k WHERE shard <> (SELECT max(shard) - 2 FROM k))"""


def _markers(spark, d):
    """A log of shards of ``lineitem``, in which one is missing."""
    k = spark.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_suppkey") % 40).cast("int").alias("shard")).agg(F.count("*").alias("records"))
    top = k.agg(F.max("shard")).first()[0]
    so_far = Window.orderBy("shard")  # a row a shard
    m = k.filter(F.col("shard") != top - 2 if top is not None else F.lit(True)).withColumn("records_done", F.sum("records").over(so_far))
    return m.withColumn("config", F.when(F.col("shard") % 9 < 6, "a").otherwise("b"))


@query(f"WITH {_MARKER_SQL}, c AS (SELECT *, CASE WHEN config <> lag(config) OVER (ORDER BY shard) THEN 1 ELSE 0 END AS c FROM m), r AS (SELECT *, sum(c) OVER (ORDER BY shard) AS run FROM c) SELECT config, min(shard) AS first_shard, max(shard) AS last_shard FROM r GROUP BY run, config")
def shard_config_history(spark, d):
    return builds.config_history(_markers(spark, d))


@query(f"WITH {_MARKER_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY shard) - 1 AS place FROM m) SELECT count(*) AS shards, CAST(coalesce(sum(records), 0) AS BIGINT) AS records FROM n WHERE shard = place")
def build_progress(spark, d):
    return builds.progress(_markers(spark, d))


@query("WITH l AS (SELECT doc_id, lang FROM documents), r AS (SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 90 <> 1) SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)")
def artifact_diff(spark, d):
    left = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    right = left.filter("doc_id % 90 <> 1").withColumn("lang", F.when(F.col("doc_id") % 100 == 0, "xx").otherwise(F.col("lang")))
    return builds.difference(left, right)


@query("SELECT 'text' AS field, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(DISTINCT text) AS distinct_values FROM documents UNION ALL SELECT 'lang', CAST(sum(strlen(lang)) AS BIGINT), count(DISTINCT lang) FROM documents UNION ALL SELECT 'source', CAST(sum(strlen(source)) AS BIGINT), count(DISTINCT source) FROM documents")
def field_bytes(spark, d):
    return builds.field_bytes(spark.read.parquet(f"{d}/documents.parquet"), ["text", "lang", "source"])


@query("""
SELECT user_id, event_id FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
) WHERE n = 1
""")
def stream_ingest_dedupe(spark, d):
    """The first event of each user, through the stream: two batches, then a stop, then
    the files that came meanwhile, from the checkpoint on."""
    base = f"{scratch(spark)}/ingest-{uuid.uuid4().hex}"
    source, files = f"{base}/source", Files(spark, base)
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id")
    cut = events.agg(F.percentile_approx("event_id", [0.25, 0.5, 0.75], 10_000)).first()[0]
    part = lambda i: F.col("event_id").between(cut[i - 1] + 1 if i else -(2**62), cut[i] if i < 3 else 2**62)
    kinds = "user_id long, event_id long"
    for run in (0, 1):
        for i in (2 * run, 2 * run + 1):
            one = f"{base}/part-{i}"
            events.filter(part(i)).coalesce(1).write.parquet(one)
            for name in files.list(one):
                if name.endswith(".parquet"):
                    Files(spark, base)._fs.mkdirs(files._path(source))
                    files.rename(f"{one}/{name}", f"{source}/{i}-{name}")
        out = ingest(spark, source, f"{base}/sink", f"{base}/state", schema=kinds, key="user_id", order=["event_id"], files_per_batch=1)
    return out.select("user_id", "event_id")
