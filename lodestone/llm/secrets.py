"""Secret scan with corpus-wide ownership, with DataFrame functions only.

Each text is scanned once.  The base kinds are ``assign`` (a keyword, a sign and a
value), ``access`` (key ids of one provider's form) and ``hex`` (long runs of small
hexadecimal digits).  Between assignments, runs of 16 or more characters of letters,
digits, _, +, = and - that mix letters and digits are candidates of the kind ``token``,
unless a base form lies in them.

What a candidate's form cannot tell, its spread over the corpus does: values are
hashed, and a hash's distinct owners and distinct repositories are counted over all
documents.  A value that more than ``max_owners`` owners hold is a widely copied
example.  Any other value belongs to its owners; it looks live unless it has few
different characters or runs like 12345 or abcde.  A ``token`` becomes a span if it is
not widely copied and looks live by itself (20 or more characters, with small and
capital letters), or is the value of a base match somewhere else, however plain: a
copy of a secret without its keyword.  Base spans always stay.

Text is read once, by the scan; what follows handles hashes and places, which are
written to the shared folder.  Counts are pre-aggregated by (hash, owner) and (hash,
repository) before they meet by hash.  A hash that makes up more than 1 / ``HOT`` of all
candidates is joined back by broadcast (there are at most ``HOT`` of them), any other by
shuffle, so no key is hot there.  Places are summed up inside a row by doubling
steps, so a text of many matches costs n log n.

Spans are places in code points, end exclusive; a base span is the whole match.

Defined results: null text is empty and has no spans; a null repository or owner counts
as one more; repeated rows are scanned one by one and add no owner; a null doc_id has
its row; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import hex_sha256, materialize, table

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "token")
MAX_OWNERS = 2
HOT = 10_000

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: All before an assignment's value.
ASSIGN_HEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
VALUE_LENGTH = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9_+=-]{16,}"
#: Runs that no generated secret is likely to have.
PLAIN = "(?i)12345|abcde|xxxx|0000|example|changeme|placeholder|your"
FEW_CHARACTERS = 8


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cut(text: str, pattern: str) -> str:
    """SQL: an array of struct<hit, text> that makes up ``text``: pieces between matches
    and, with hit true, matches."""
    hits, parts = f"regexp_extract_all({text}, {_sql(pattern)}, 0)", f"split({text}, {_sql(pattern)}, -1)"
    both = f"zip_with({parts}, {hits}, (p, h) -> if(h is null, array(named_struct('hit', false, 'text', p)), array(named_struct('hit', false, 'text', p), named_struct('hit', true, 'text', h))))"
    return f"if({text} rlike {_sql(pattern)}, flatten({both}), array(named_struct('hit', false, 'text', {text})))"


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", repository: Column, owner: Column) -> DataFrame:
    """rid, doc_id, repository, owner and ``found``: an array of struct<kind, start, end,
    hash, strong, plain> of base spans and token candidates, by start and kind.  Written
    to the shared folder, without text."""
    spread = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))  # noqa: E731  null is one more
    base = docs.select(F.col(doc_id).alias("doc_id"), spread(repository).alias("repository"), spread(owner).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # Pieces of all kinds behind one another, each kind's in the order of the text.
    df = base.withColumn("p0", F.expr(f"transform({_cut('t', ASSIGN)}, x -> named_struct('kind', if(x.hit, 'assign', null), 'text', x.text))"))
    inner = f"transform({_cut('x.text', TOKEN)}, y -> named_struct('kind', if(y.hit, 'token', null), 'text', y.text))"
    df = df.withColumn("p0", F.expr(f"flatten(transform(p0, x -> if(x.kind is null, {inner}, array(x))))"))
    for name, kind, pattern in (("p1", "access", ACCESS), ("p2", "hex", HEX)):
        df = df.withColumn(name, F.expr(f"transform({_cut('t', pattern)}, x -> named_struct('kind', if(x.hit, '{kind}', null), 'text', x.text))"))
    one = lambda name: f"transform({name}, x -> named_struct('kind', x.kind, 'size', length(x.text), 'text', if(x.kind is null, null, x.text)))"
    df = df.withColumn("length", F.length("t").cast("bigint")).withColumn("pieces", F.expr(f"concat({one('p0')}, {one('p1')}, {one('p2')})")).drop("t", "p0", "p1", "p2")
    # Each of the three arrays makes up the whole text, so places start anew at its length.
    ahead = "concat(array_repeat(0L, shiftleft(1, s)), slice(a, 1, size(a) - shiftleft(1, s)))"
    step = f"(a, s) -> if(size(a) > shiftleft(1, s), zip_with(a, {ahead}, (x, y) -> x + y), a)"
    df = df.withColumn("ends", F.expr(f"aggregate(sequence(0, cast(log2(size(pieces)) as int)), transform(pieces, x -> cast(x.size as bigint)), {step})"))
    spans = "filter(zip_with(pieces, ends, (x, e) -> if(x.kind is null, null, named_struct('kind', x.kind, 'start', pmod(e - x.size, length), 'size', x.size, 'text', x.text))), x -> x is not null)"
    df = df.withColumn("spans", F.expr(spans)).drop("pieces", "ends", "length")
    head = f"regexp_replace(x.text, {_sql(ASSIGN_HEAD)}, '')"
    df = df.withColumn("spans", F.expr(f"transform(spans, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.start + x.size, 'value', if(x.kind = 'assign', {head}, x.text)))"))
    mixed = f"x.value rlike '[0-9]' and x.value rlike '[A-Za-z]' and not x.value rlike {_sql(ACCESS)} and not x.value rlike {_sql(HEX)}"
    df = df.withColumn("spans", F.expr(f"filter(spans, x -> case x.kind when 'assign' then length(x.value) >= {VALUE_LENGTH} when 'token' then {mixed} else true end)"))
    strong = "length(x.value) >= 20 and x.value rlike '[a-z]' and x.value rlike '[A-Z]'"
    plain = f"size(array_distinct(split(x.value, ''))) < {FEW_CHARACTERS} or x.value rlike {_sql(PLAIN)}"
    order = "case x.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    df = df.withColumn("found", F.expr(f"array_sort(transform(spans, x -> named_struct('start', x.start, 'nr', {order}, 'kind', x.kind, 'end', x.end, 'hash', unhex(sha2(x.value, 256)), 'strong', {strong}, 'plain', {plain})))"))
    return materialize(df.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "repository", "owner", "found"), "candidates")


def ownership(seen: DataFrame) -> DataFrame:
    """hash, occurrences, owners, repositories, in_base (a base match has that value)."""
    by_owner = seen.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.max(F.col("nr") < 3).alias("in_base"))
    by_repository = seen.groupBy("hash", "repository").agg(F.lit(1).alias("one"))
    owners = by_owner.groupBy("hash").agg(F.sum("n").alias("occurrences"), F.count("*").alias("owners"), F.max("in_base").alias("in_base"))
    return owners.join(by_repository.groupBy("hash").agg(F.count("*").alias("repositories")), "hash")


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", repository: Column | None = None, owner: Column | None = None, max_owners: int = MAX_OWNERS, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of struct<kind, start, end>,
    the latter with the method's own, and with owners, repositories, verdict: "example",
    "live" or "plain")."""
    repository, owner = F.col(doc_id) if repository is None else repository, F.col("source") if owner is None else owner
    rows = candidates(docs, doc_id=doc_id, text=text, repository=repository, owner=owner)
    seen = rows.select("rid", "repository", "owner", F.explode("found").alias("x")).select("rid", "repository", "owner", "x.*")
    spread = materialize(ownership(seen), "ownership")
    total = spread.agg(F.sum("occurrences").alias("n")).first()["n"] or 0
    is_hot = F.col("occurrences") * hot > total  # fewer than ``hot`` hashes
    hot_side = F.broadcast(spread.filter(is_hot).select("hash", F.struct("owners", "repositories", "in_base").alias("hot")))
    cold_side = spread.filter(~is_hot).select("hash", F.struct("owners", "repositories", "in_base").alias("cold"))
    split = seen.join(hot_side, "hash", "left")
    few = [c for c in split.columns if c != "hot"]
    known = split.filter("hot is not null").select(*few, F.col("hot").alias("by")).unionByName(split.filter("hot is null").drop("hot").join(cold_side, "hash").select(*few, F.col("cold").alias("by")))
    verdict = F.when(F.col("by.owners") > max_owners, "example").when(F.col("plain"), "plain").otherwise("live")
    known = known.select("*", verdict.alias("verdict")).filter("nr < 3 or (by.owners <= %d and (by.in_base or (strong and verdict = 'live')))" % max_owners)
    span = F.struct("start", "nr", "kind", "end", F.col("by.owners").alias("owners"), F.col("by.repositories").alias("repositories"), "verdict")
    per_doc = known.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = rows.select("rid", "doc_id").join(per_doc, "rid", "left")
    none = "cast(array() as array<struct<kind:string,start:bigint,end:bigint,owners:bigint,repositories:bigint,verdict:string>>)"
    spans = F.coalesce(F.expr("transform(spans, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'owners', x.owners, 'repositories', x.repositories, 'verdict', x.verdict))"), F.expr(none))
    out = out.select("doc_id", spans.alias("spans"))
    return out.select("doc_id", F.expr("transform(filter(spans, x -> x.kind <> 'token'), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))").alias("base"), "spans")


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def op13_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_live, n_example.  A document stands for a repository, its source for the owner."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:3]]
    verdicts = [F.expr(f"cast(size(filter(spans, x -> x.verdict = '{v}')) as bigint)").alias(f"n_{v}") for v in ("live", "example")]
    return found.select("doc_id", *counts, hex_sha256(listed("base")).alias("base_sha256"), listed("spans").alias("spans"), *verdicts)


def _op13_sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    size = lambda x, a, b: f"coalesce(list_sum(list_transform({x}[{a}:{b}], lambda y: length(y))), 0)"
    start = f"{size('p', 1, 'i')} + {size('h', 1, 'i - 1')}"
    cut = lambda x, pattern: f"regexp_split_to_array({x}, {q(pattern)}) AS p, regexp_extract_all({x}, {q(pattern)}) AS h"
    has = lambda pattern: f"regexp_matches(v, {q(pattern)})"
    kinds = " UNION ALL ".join(f"SELECT rid, {nr} AS nr, {start} AS s, h[i] AS m FROM (SELECT rid, p, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT rid, {cut('t', pattern)} FROM d))" for nr, pattern in ((1, ACCESS), (2, HEX)))
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(0)) AS owner, coalesce(text, '') AS t FROM documents),
a AS MATERIALIZED (SELECT rid, {cut('t', ASSIGN)} FROM d),
g AS (SELECT rid, off, {cut('x', TOKEN)} FROM (SELECT rid, p[i] AS x, {size('p', 1, 'i - 1')} + {size('h', 1, 'i - 1')} AS off
      FROM (SELECT rid, p, h, unnest(range(1, len(p) + 1)) AS i FROM a))),
m AS (SELECT rid, 0 AS nr, {start} AS s, h[i] AS m FROM (SELECT rid, p, h, unnest(range(1, len(h) + 1)) AS i FROM a)
      UNION ALL {kinds}
      UNION ALL SELECT rid, 3, off + {start}, h[i] FROM (SELECT rid, off, p, h, unnest(range(1, len(h) + 1)) AS i FROM g)),
v AS MATERIALIZED (SELECT rid, nr, s, s + length(m) AS e, sha256(v) AS h,
        length(v) >= 20 AND {has('[a-z]')} AND {has('[A-Z]')} AS strong,
        len(list_distinct(string_split(v, ''))) < {FEW_CHARACTERS} OR {has(PLAIN)} AS plain
      FROM (SELECT rid, nr, s, m, CASE WHEN nr = 0 THEN regexp_replace(m, {q(ASSIGN_HEAD)}, '') ELSE m END AS v FROM m)
      WHERE CASE nr WHEN 0 THEN length(v) >= {VALUE_LENGTH} WHEN 3 THEN {has('[0-9]')} AND {has('[A-Za-z]')} AND NOT {has(ACCESS)} AND NOT {has(HEX)} ELSE true END),
o AS (SELECT h, count(DISTINCT owner) AS owners, bool_or(nr < 3) AS in_base FROM v JOIN d USING (rid) GROUP BY h),
k AS (SELECT rid, nr, s, e, CASE WHEN owners > {MAX_OWNERS} THEN 'example' WHEN plain THEN 'plain' ELSE 'live' END AS verdict
      FROM v JOIN o USING (h) WHERE nr < 3 OR owners <= {MAX_OWNERS} AND (in_base OR strong AND NOT plain)),
r AS (SELECT rid, nr, s, verdict, (['assign', 'access', 'hex', 'token'])[nr + 1] || ':' || s || ':' || e AS x FROM k),
z AS (SELECT rid, count(*) FILTER (nr = 0) AS n_assign, count(*) FILTER (nr = 1) AS n_access, count(*) FILTER (nr = 2) AS n_hex,
        string_agg(x, ',' ORDER BY s, nr) FILTER (nr < 3) AS base, string_agg(x, ',' ORDER BY s, nr) AS spans,
        count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example FROM r GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN z USING (rid)
"""


OP13_SQL = _op13_sql()
