"""Text functions: title keys, prefixes, identifiers and ranking boosts.

Column functions are built-in expressions; the few that need Unicode
normalisation run on the driver, over query strings only.
"""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a title: letters, digits, underscore and hyphen, without marks.
TOKEN = r"[\p{L}\p{N}_-]+"
PREFIX_WORDS = (3, 12)
MAX_VARIANTS = 12
#: The citation buckets of the service's filter.
CITATION_BUCKETS = (0, 10, 50, 100, 500, 1000, 5000, 10000)


#: Lower-case characters that case folding still changes, from the Unicode data: those
#: that become one character, and those that become several.
_CHANGED = {c: c.casefold() for c in map(chr, range(0x110000)) if c.lower() == c and c.casefold() != c}
FOLD_ONE = {c: f for c, f in _CHANGED.items() if len(f) == 1}
FOLD_MORE = {c: f for c, f in _CHANGED.items() if len(f) > 1}


def _ranges(chars, gap: int = 64) -> str:
    """A few ranges that hold ``chars``, and maybe others between them, as a pattern: a class
    of hundreds of single characters is tried one by one."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c - out[-1][1] <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in out) + "]"


#: Holds every character that case folding changes beyond lower case.
_MAY_CHANGE = _ranges(_CHANGED)


def casefold(text: Column) -> Column:
    """Case folding as of the Unicode data.  Few texts hold a character that lower case
    leaves and folding changes; only these are gone through further."""
    plain = F.lower(text)
    low = F.translate(plain, "".join(FOLD_ONE), "".join(FOLD_ONE.values()))
    table = F.create_map(*[F.lit(x) for pair in FOLD_MORE.items() for x in pair])
    slow = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(table[c], c)), "")
    folded = F.when(F.rlike(low, F.lit(f"[{''.join(FOLD_MORE)}]")), slow).otherwise(low)
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, plain).when(~F.rlike(plain, F.lit(_MAY_CHANGE)), plain).otherwise(folded)


def casefold_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    out = f"translate(lower({text}), '{''.join(FOLD_ONE)}', '{''.join(FOLD_ONE.values())}')"
    for c, f in FOLD_MORE.items():
        out = f"replace({out}, '{c}', '{f}')"
    return f"CASE WHEN regexp_matches({text}, '[^\\x00-\\x7F]') THEN {out} ELSE lower({text}) END"


def tokens(title: Column) -> Column:
    return F.regexp_extract_all(casefold(title), F.lit(TOKEN), F.lit(0))


def normalize_title(title: Column) -> Column:
    """Case-folded tokens joined by single spaces."""
    return F.array_join(tokens(F.coalesce(title, F.lit(""))), " ")


def clean(text: Column) -> Column:
    """Collapse white space runs and strip; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def prefixes(normalized: Column) -> Column:
    """Array of the proper prefixes of 3 to 12 words; none for 3 words or fewer."""
    words = F.split(normalized, " ")
    low, high = PREFIX_WORDS
    last = F.least(F.size(words) - 1, F.lit(high))
    made = F.transform(F.sequence(F.lit(low), F.greatest(last, F.lit(low))), lambda n: F.array_join(F.slice(words, 1, n), " "))
    return F.when(F.size(words) > low, made).otherwise(F.array().cast("array<string>"))


def work_id(value: Column) -> Column:
    """``W<digits>`` from any spelling of an identifier or its URL, else empty."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), r"[?#].*$", ""), r"/+$", "")
    number = F.regexp_extract(bare, r"^(?:.*/)?[wW]([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("W"), number)).otherwise(F.lit(""))


def doi(value: Column) -> Column:
    """Lower-cased DOI without a resolver's prefix."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")


def citation_bucket(count: Column) -> Column:
    """The largest bucket that is not above the count."""
    return F.array_max(F.filter(F.array(*map(F.lit, CITATION_BUCKETS)), lambda b: b <= F.greatest(count, F.lit(0))))


def citation_boost(count: Column) -> Column:
    return F.least(F.log1p(F.greatest(count, F.lit(0)).cast("double")) / F.log1p(F.lit(100000.0)), F.lit(1.0))


def recency_boost(year: Column) -> Column:
    return F.least(F.greatest((year - 1950) / 100.0, F.lit(0.0)), F.lit(1.0)) * 0.03


# Driver side: spellings of one typed title.


def plain_key(text: str) -> str:
    return " ".join(re.findall(r"[\w-]+", text.casefold()))


def fold_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _drop_tags(text: str) -> str:
    """Entities read, then short tags (a name right behind ``<``) become a space."""
    return re.sub(r"</?[A-Za-z][^<>]{0,60}>", " ", html.unescape(text))


#: Ways in which a stored title may be spelled, in the order of their keys.
SPELLINGS = (
    lambda t: t,
    lambda t: re.sub("[\u2010-\u2015\u2212]", "-", t),
    lambda t: unicodedata.normalize("NFC", t),
    lambda t: unicodedata.normalize("NFKC", t),
    _drop_tags,
    fold_accents,
    lambda t: re.sub("['`\u2018\u2019\u02bc]", "", t),
    lambda t: unicodedata.normalize("NFD", t),
    lambda t: t.replace("&", "&amp;"),
)


def title_key_variants(text: str) -> list[str]:
    """Distinct keys under which a stored title may stand, the literal one first, then
    its forms without hyphens, then those of each other spelling."""
    plain = [spell(text) for spell in SPELLINGS]
    hyphens = [form.replace("-", by) for form in plain for by in (" ", "")]
    keys = (plain_key(form) for form in [plain[0], *hyphens[:2], *plain[1:], *hyphens[2:]])
    return list(dict.fromkeys(key for key in keys if key))[:MAX_VARIANTS]


def numeric_id(value: Column) -> Column:
    """The number of a work id; null if it is none."""
    return F.nullif(F.substring(work_id(value), 2, 40), F.lit("")).cast("long")


def surname(authors: Column) -> Column:
    """Last word of the first author's name, case-folded; empty without one.  Accents
    of Latin letters are folded by a fixed table, as Spark has no normalisation."""
    name = normalize_title(F.translate(F.lower(F.coalesce(F.get(authors, F.lit(0)), F.lit(""))), ACCENTED, UNACCENTED))
    return F.coalesce(F.element_at(F.split(name, " "), -1), F.lit(""))


#: Latin letters that decompose into one ASCII letter and marks, from the Unicode data.
_FOLDED = {chr(c): fold_accents(chr(c)) for c in range(0xC0, 0x250)}
ACCENTED = "".join(c for c, f in _FOLDED.items() if len(f) == 1 and f.isascii())
UNACCENTED = "".join(_FOLDED[c] for c in ACCENTED)
