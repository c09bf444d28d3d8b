"""Format-preserving pseudonyms by keyed Feistel networks, with SQL functions only.

Found and validated: e-mail addresses, IPv4 addresses (octets within 255), payment
card numbers (13 to 19 digits, Luhn), phone numbers (+country code), US social
security numbers (valid area, group and serial) and dates (ISO, or day first; real
days of 1800 to 2199).  Each value is permuted inside its own format: a card stays
a valid card of the same length and spacing, a date stays a date, an address keeps
its shape and an e-mail address its top-level domain.  As the permutation depends
only on key and kind, equal values stay equal across documents; as it is a
permutation, different values stay different, and the key's holder can undo it.

A Feistel network here works on a pair (L, R) in Z_a x Z_b: even rounds add a keyed
SHA-256 of R to L modulo a, odd rounds one of L to R modulo b.  That is a
permutation for any a and b, so domains such as valid dates (146,097 days are
189 * 773) need no cycle walking.

Texts are split at matches of one pattern; pieces and permuted matches are joined
again.  Texts without a digit or an @ pass by unchanged.

Defined results: null text stays null, with nothing found; a value that looks like
a kind but fails its validation stays as it is; repeated rows, a null doc_id and an
empty table need no care, as rows are handled one by one; other columns pass
through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import hex_sha256, table

ROUNDS = 10
KINDS = ("email", "ipv4", "date", "ssn", "phone", "card")

_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}(?: ?\([0-9]{2,4}\))?(?:[ -]?[0-9]{2,5}){2,4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
}


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(left: str, right: str, a: str, b: str, kind: str, key: str, undo: bool = False) -> str:
    """SQL: struct<l, r> (bigint), the permuted pair of Z_a x Z_b."""
    sign = "-" if undo else "+"
    steps = f"sequence({ROUNDS - 1}, 0, -1)" if undo else f"sequence(0, {ROUNDS - 1})"

    def noise(x: str, modulus: str) -> str:
        return f"pmod(cast(conv(substr(sha2(concat_ws('|', {_sql(key)}, {_sql(kind)}, {a}, {b}, i, {x}), 256), 1, 15), 16, 10) as bigint), {modulus})"

    even = f"named_struct('l', pmod(s.l {sign} {noise('s.r', a)}, {a}), 'r', s.r)"
    odd = f"named_struct('l', s.l, 'r', pmod(s.r {sign} {noise('s.l', b)}, {b}))"
    return f"aggregate({steps}, named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> if(i % 2 = 0, {even}, {odd}))"


def digits(d: str, kind: str, key: str, undo: bool = False) -> str:
    """SQL: a string of 2 to 36 digits, permuted among those of its length."""
    n = f"length({d})"
    half = f"({n} div 2)"
    a, b = f"cast(rpad('1', {half} + 1, '0') as bigint)", f"cast(rpad('1', {n} - {half} + 1, '0') as bigint)"
    pair = feistel(f"substr({d}, 1, {half})", f"substr({d}, {half} + 1)", a, b, kind, key, undo)
    return f"transform(array({pair}), p -> concat(lpad(cast(p.l as string), {half}, '0'), lpad(cast(p.r as string), {n} - {half}, '0')))[0]"


def refill(shape: str, new: str) -> str:
    """SQL: ``shape`` with its digits replaced by those of ``new``, in order."""
    at = f"length(regexp_replace(substr({shape}, 1, j), '[^0-9]', ''))"
    return f"array_join(transform(sequence(1, length({shape})), j -> if(substr({shape}, j, 1) rlike '[0-9]', substr({new}, {at}, 1), substr({shape}, j, 1))), '')"


def luhn_digit(payload: str) -> str:
    """SQL: the check digit of a payload."""
    d = f"cast(substr({payload}, length({payload}) - g, 1) as int)"
    total = f"aggregate(sequence(0, length({payload}) - 1), 0, (t, g) -> t + if(g % 2 = 0, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d}))"
    return f"cast(pmod(10 - pmod({total}, 10), 10) as string)"


def letters(s: str, kind: str, key: str, undo: bool = False) -> str:
    """SQL: a string whose letters and digits are permuted within their class.

    Each half's characters are shifted by a keyed stream over the other half; a
    single character is shifted by the key alone."""
    sign = "-" if undo else "+"
    steps = f"sequence({ROUNDS - 1}, 0, -1)" if undo else f"sequence(0, {ROUNDS - 1})"

    def shift(x: str, other: str) -> str:
        c = f"ascii(substr({x}, j, 1))"
        stream = f"cast(conv(substr(sha2(concat_ws('|', {_sql(key)}, {_sql(kind)}, i, j, {other}), 256), 1, 8), 16, 10) as bigint)"
        move = lambda base, size: f"chr({base} + pmod({c} - {base} {sign} {stream}, {size}))"
        char = f"case when {c} between 48 and 57 then {move(48, 10)} when {c} between 97 and 122 then {move(97, 26)} when {c} between 65 and 90 then {move(65, 26)} else substr({x}, j, 1) end"
        return f"if({x} = '', '', array_join(transform(sequence(1, length({x})), j -> {char}), ''))"

    half = f"(length({s}) div 2)"
    even = f"named_struct('l', {shift('s.l', 's.r')}, 'r', s.r)"
    odd = f"named_struct('l', s.l, 'r', {shift('s.r', 's.l')})"
    pair = f"aggregate({steps}, named_struct('l', substr({s}, 1, {half}), 'r', substr({s}, {half} + 1)), (s, i) -> if(i % 2 = 0, {even}, {odd}))"
    return f"transform(array({pair}), p -> concat(p.l, p.r))[0]"


def _permute(kind: str, m: str, key: str, undo: bool) -> str:
    """SQL: the pseudonym of match ``m`` if it is valid, else null."""
    d = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "email":
        name, host = f"substring_index({m}, '@', 1)", f"substring_index({m}, '@', -1)"
        body, top = f"substr({host}, 1, length({host}) - length(substring_index({host}, '.', -1)) - 1)", f"substring_index({host}, '.', -1)"
        return f"concat({letters(name, 'email', key, undo)}, '@', {letters(body, 'host', key, undo)}, '.', {top})"
    if kind == "ipv4":
        part = lambda n: f"cast(split({m}, '[.]')[{n}] as bigint)"
        pair = feistel(f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536L", "65536L", kind, key, undo)
        new = f"transform(array({pair}), p -> concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256))[0]"
        return f"if(forall(split({m}, '[.]'), o -> cast(o as int) <= 255 and cast(cast(o as int) as string) = o), {new}, null)"
    if kind == "date":
        form = f"case when substr({m}, 5, 1) = '-' then 'yyyy-MM-dd' when substr({m}, 3, 1) = '/' then 'dd/MM/yyyy' else 'dd.MM.yyyy' end"
        iso = f"case when substr({m}, 5, 1) = '-' then {m} else concat_ws('-', substr({m}, 7, 4), substr({m}, 4, 2), substr({m}, 1, 2)) end"
        day = f"datediff(try_cast({iso} as date), date'1800-01-01')"
        pair = feistel(f"{day} div 773", f"{day} % 773", "189L", "773L", kind, key, undo)
        new = f"transform(array({pair}), p -> date_format(date_add(date'1800-01-01', cast(p.l * 773 + p.r as int)), {form}))[0]"
        return f"if(try_cast({iso} as date) between date'1800-01-01' and date'2199-12-31', {new}, null)"
    if kind == "ssn":
        area = f"(cast(substr({d}, 1, 3) as bigint) - if(cast(substr({d}, 1, 3) as int) > 666, 2, 1))"
        pair = feistel(f"{area} * 99 + cast(substr({d}, 4, 2) as bigint) - 1", f"cast(substr({d}, 6, 4) as bigint) - 1", "88902L", "9999L", kind, key, undo)
        new = f"transform(array({pair}), p -> concat_ws('-', lpad(cast(p.l div 99 + if(p.l div 99 >= 665, 2, 1) as string), 3, '0'), lpad(cast(p.l % 99 + 1 as string), 2, '0'), lpad(cast(p.r + 1 as string), 4, '0')))[0]"
        return f"if(substr({d}, 1, 3) not in ('000', '666') and substr({d}, 1, 1) <> '9' and substr({d}, 4, 2) <> '00' and substr({d}, 6, 4) <> '0000', {new}, null)"
    if kind == "phone":
        code = f"regexp_extract({m}, '^[+][0-9]{{1,3}}', 0)"
        rest = f"substr({m}, length({code}) + 1)"
        own = f"regexp_replace({rest}, '[^0-9]', '')"
        new = f"concat({code}, transform(array({own}), q -> transform(array({digits('q', kind, key, undo)}), z -> {refill(rest, 'z')})[0])[0])"
        return f"if(length({own}) between 6 and 14, {new}, null)"
    body = f"substr({d}, 1, length({d}) - 1)"
    inner = f"transform(array({digits('q', kind, key, undo)}), y -> concat(y, {luhn_digit('y')}))[0]"
    new = f"transform(array({body}), q -> transform(array({inner}), z -> {refill(m, 'z')})[0])[0]"
    return f"if({luhn_digit(body)} = substr({d}, -1), {new}, null)"


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with values in ``text`` replaced, and the column ``found``: an array
    of struct<kind, position> of what was replaced (position: among all matches)."""
    pattern = "|".join(f"(?:{p})" for p in _PATTERNS.values())
    t = f"`{text}`"
    has = f"coalesce({t} rlike '[0-9@]', false)"
    spans = docs.withColumn("_pn_hits", F.expr(f"if({has}, regexp_extract_all({t}, {_sql(pattern)}, 0), cast(array() as array<string>))"))
    spans = spans.withColumn("_pn_parts", F.expr(f"if(size(_pn_hits) > 0, split({t}, {_sql(pattern)}, -1), cast(array() as array<string>))"))
    kind = "case " + " ".join(f"when m rlike {_sql('^(?:' + p.split(')', 1)[1].rsplit('(?!', 1)[0] + ')$' if p.startswith('(?<!') else '^(?:' + p + ')$')} then {_sql(k)}" for k, p in _PATTERNS.items()) + " end"
    spans = spans.withColumn("_pn_kinds", F.expr(f"transform(_pn_hits, m -> {kind})"))
    cases = "case k " + " ".join(f"when '{k}' then {_permute(k, 'm', key, undo)}" for k in KINDS) + " end"
    spans = spans.withColumn("_pn_new", F.expr(f"zip_with(_pn_hits, _pn_kinds, (m, k) -> {cases})"))
    joined = "array_join(flatten(zip_with(_pn_parts, zip_with(_pn_hits, _pn_new, (m, n) -> coalesce(n, m)), (part, new) -> array(part, coalesce(new, '')))), '')"
    out = spans.withColumn("found", F.expr("filter(zip_with(_pn_kinds, transform(_pn_new, (n, i) -> if(n is null, null, i)), (k, i) -> named_struct('kind', k, 'position', i)), x -> x.position is not null)"))
    return out.withColumn(text, F.when(F.size("_pn_hits") > 0, F.expr(joined)).otherwise(F.col(text))).drop("_pn_hits", "_pn_parts", "_pn_kinds", "_pn_new")


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_found, a count by kind, text, text_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, "corpus-key-1")
    counts = [F.size(F.expr(f"filter(found, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), *counts, "text", hex_sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"))
