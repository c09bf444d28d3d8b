"""Benchmark decontamination by winnowing, with DataFrame functions only.

A *window* is ``n`` consecutive words of a benchmark item (an item of fewer words,
but not none, is one window as a whole).  Both sides are winnowed alike: of each run
of ``n`` words the leftmost smallest hash among its ``k``-word grams is chosen, and
each chosen place is kept once, however many runs choose it.  A run that both sides
share chooses the same gram in both, so every shared span of ``n`` words has a
fingerprint in common, wherever it starts.

Documents' fingerprints are joined with the items' in one generated-code stage, and
each match is extended there: word by word to the left and to the right, up to
``n - k`` words either way.  An extended match of ``n`` words or more is a hit, so a
hash can't make a false one; longer spans are the union of their fingerprints' hits.
Only hits leave the stage.

The benchmark side is broadcast only if its counted fingerprints are within
``broadcast_windows``; otherwise Spark joins by shuffle, and each place carries its
own few words.  Sentinel fingerprints, one a document, keep every document in the
result without a second scan; in a shuffle they are dealt over many keys.

Defined results: null or wordless text has no words and no hit; null or wordless
items have no window; equal fingerprints of many items are compared once and count
for each item; repeated rows each give their own result row; a null doc_id is kept
as null; an empty benchmark hits nothing.  Columns other than those named are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, hex_sha256, lower_ascii, table

WINDOW = 8
GRAM = 5
MIN_ITEMS = 2
#: Most benchmark fingerprints (about 300 bytes each) that are broadcast.
BROADCAST_WINDOWS = 200_000
#: Bits of a gram's place (words of one text: 2^28 at most); the others are its hash.
PLACE_BITS = 28
#: Keys that documents' sentinels are dealt over in a shuffle.
SENTINELS = 4096
#: What separates words once A-Z are lower-cased: [\x00-\x2F\x3A-\x60\x7B-\x7F].
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def _fold(df: DataFrame, out: str, source: str, n: int, joiner: str) -> DataFrame:
    """Add ``out``: for each start, ``joiner`` folded over ``n`` neighbours of
    ``source``, in about log2(n) passes; each pass is a column, so that no
    expression is computed twice."""
    if n == 1:
        return df.withColumn(out, F.col(source))
    name, size, step = source, 1, 0

    def zipped(a: str, b: str, shift: int) -> Column:
        rest = f"greatest(size({a}) - {shift}, 0)" if a == b else f"greatest(size({b}) - {shift}, 0)"
        # Both sides are cut to the same length: zip_with pads the shorter with nulls.
        return F.expr(f"zip_with(slice({a}, 1, {rest}), slice({b}, {shift + 1}, {rest}), (x, y) -> {joiner}(x, y))")

    for bit in bin(n)[3:]:
        step += 1
        df = df.withColumn(f"{out}_{step}", zipped(name, name, size))
        name, size = f"{out}_{step}", size * 2
        if bit == "1":
            step += 1
            df = df.withColumn(f"{out}_{step}", zipped(name, source, size))
            name, size = f"{out}_{step}", size + 1
    return df.withColumn(out, F.col(name)).drop(*[f"{out}_{i}" for i in range(1, step)], *([] if name == out else [f"{out}_{step}"]))


def winnowed(df: DataFrame, length: int, gram: int, out: str) -> DataFrame:
    """Add ``out``: the distinct choices of the ``length``-word runs, each a long of
    the gram's hash above PLACE_BITS bits of its place, so that the smallest is the
    leftmost of equal hashes.  Needs ``hashes``, the word hashes."""
    k = min(gram, length)
    df = _fold(df, f"{out}_g", "hashes", k, "xxhash64")
    df = df.withColumn(f"{out}_p", F.expr(f"transform({out}_g, (x, i) -> shiftleft(shiftright(x, {PLACE_BITS}), {PLACE_BITS}) | i)")).drop(f"{out}_g")
    if length == k:
        return df.withColumnRenamed(f"{out}_p", out)
    df = _fold(df, f"{out}_m", f"{out}_p", length - k + 1, "least")
    return df.withColumn(out, F.array_distinct(f"{out}_m")).drop(f"{out}_m", f"{out}_p")


def _parts(choice: Column) -> tuple[Column, Column]:
    """(fingerprint, place) of a choice."""
    return F.shiftright(choice, PLACE_BITS), choice.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def item_fingerprints(items: DataFrame, *, item_id: str, text: str, window: int, gram: int) -> tuple[DataFrame, list[int]]:
    """(length, fp, gram and the words before it, nearest first, and after it, and the
    item_ids), and the window lengths in use."""
    base = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter("size(w) > 0")
    base = base.withColumn("length", F.least(F.size("w"), F.lit(window))).withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    lengths = sorted(r["length"] for r in base.select("length").distinct().limit(window).collect())
    out = None
    for n in lengths:
        k = min(gram, n)
        one = winnowed(base.filter(F.col("length") == n), n, gram, "at")
        one = one.select("item", "w", F.explode("at").alias("choice"))
        fp, place = _parts(F.col("choice"))
        one = one.select("item", "w", fp.alias("fp"), place.alias("p"))
        one = one.selectExpr(
            "item",
            f"{n} as length",
            "fp",
            f"slice(w, p + 1, {k}) as gram",
            f"reverse(slice(w, greatest(p - {n - k}, 0) + 1, least(p, {n - k}))) as before",
            f"slice(w, p + {k + 1}, {n - k}) as after",
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        return base, []
    return out.groupBy("length", "fp", "gram", "before", "after").agg(F.collect_set("item").alias("item_ids")), lengths


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, min_items: int = MIN_ITEMS, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit (words inside a hit window),
    n_items, item_ids (sorted as strings), contaminated (n_items >= min_items)."""
    spark = docs.sparkSession
    prints, lengths = item_fingerprints(items, item_id=item_id, text=item_text, window=window, gram=gram)
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    if not lengths:
        return base.select("doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("item_ids"), F.lit(False).alias("contaminated"))
    df = base.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    for n in lengths:
        df = winnowed(df, n, gram, f"at{n}")
    small = bounded(prints, broadcast_windows)
    keys = 1 if small else SENTINELS
    # All choices side by side behind the sentinel; the index tells the length.
    df = df.withColumn("marks", F.concat(F.array(F.pmod("rid", F.lit(keys))), *[F.col(f"at{n}") for n in lengths]))
    before, length = F.lit(1), F.when(F.col("index") == 0, F.lit(0))
    for n in lengths:
        before = before + F.size(f"at{n}")
        df = df.withColumn(f"to{n}", before)
        length = length.when(F.col("index") < F.col(f"to{n}"), F.lit(n))
        before = F.col(f"to{n}")
    df = df.drop("hashes", *[f"at{n}" for n in lengths])
    # Never empty; the outer form keeps Spark from testing size(marks) in a filter
    # below, which would compute all the arrays twice.
    rows = df.select("rid", "doc_id", "w", *[f"to{n}" for n in lengths], F.posexplode_outer("marks").alias("index", "choice"))
    fp, place = _parts(F.col("choice"))
    rows = rows.select("rid", "doc_id", "w", F.when(F.col("index") == 0, F.col("choice")).otherwise(fp).alias("fp"), length.alias("length"), place.alias("p"))
    none = F.array().cast("array<string>")
    side = prints.unionByName(spark.range(keys).select(F.lit(0).alias("length"), F.col("id").alias("fp"), *[none.alias(c) for c in ("gram", "before", "after", "item_ids")]))
    k, reach = F.least(F.col("length"), F.lit(gram)), max(0, window - gram)
    n_words = F.size("w").cast("long").alias("n_words")
    own = F.slice("w", F.col("p") + 1, k)
    if small:
        hits = rows.join(F.broadcast(side), ["fp", "length"])
        left, right = (lambda i: F.get("w", F.col("p") - 1 - i)), (lambda i: F.get("w", F.col("p") + k + i))
        hits = hits.filter((F.col("length") == 0) | (own == F.col("gram")))
    else:
        # Each place takes its own few words along, not the document's.
        far = F.col("length") - k
        back = F.reverse(F.slice("w", F.greatest(F.col("p") - far, F.lit(0)) + 1, F.least("p", far)))
        rows = rows.select("rid", "doc_id", n_words, "fp", "length", "p", own.alias("own"), back.alias("back"), F.slice("w", F.col("p") + k + 1, far).alias("ahead"))
        hits = rows.join(side, ["fp", "length"]).filter("length = 0 OR own = gram")
        left, right = (lambda i: F.get("back", F.lit(i))), (lambda i: F.get("ahead", F.lit(i)))

    def extent(doc, item: str) -> Column:
        """Words that agree in a row, from the gram on; item words end at the window."""
        out = F.lit(reach)
        for i in range(reach - 1, -1, -1):
            out = F.when(~F.coalesce(doc(i) == F.get(item, F.lit(i)), F.lit(False)), F.lit(i)).otherwise(out)
        return out

    hits = hits.select("rid", "doc_id", *([n_words] if small else ["n_words"]), "length", (F.col("p") - extent(left, "before")).alias("start"), (F.col("p") + k + extent(right, "after")).alias("end"), "item_ids")
    hits = hits.filter("length = 0 OR end - start >= length")
    spot = F.when(F.col("length") > 0, F.struct("start", "end"))
    per_doc = hits.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.collect_set(spot).alias("spots"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    covered = F.transform("spots", lambda s: F.sequence(s["start"], s["end"] - 1))
    per_doc = per_doc.withColumn("n_hit", F.size(F.array_distinct(F.flatten(covered))).cast("long"))
    return per_doc.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.size("item_ids") >= min_items).alias("contaminated"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", hex_sha256(F.array_join("item_ids", ",")).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 8) AS n FROM b WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
         FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
ns AS (SELECT DISTINCT n FROM bwin),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dwin.doc_id, dwin.n, dwin.i, bwin.item_id FROM dwin JOIN bwin ON dwin.win = bwin.win AND dwin.n = bwin.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(i.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cover c ON c.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""
