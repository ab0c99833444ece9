"""Column functions for cleaning text; none of them has an action or a Python worker unless it says so."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholar_spark import schema as S


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(*S.MISSING)


def present(c: Column) -> Column:
    """The value, null where it is a missing-value token."""
    return F.when(~is_missing(c), c)


def lookup(c: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """``table[c]`` from a literal map."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, default)


def fold_width(c: Column) -> Column:
    """NFKC by an Arrow function, only where a text has other than ASCII characters."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def strip_accents(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), _bare(c)).otherwise(c)


@F.pandas_udf(T.StringType())
def _bare(s: pd.Series) -> pd.Series:
    bare = lambda x: "".join(ch for ch in unicodedata.normalize("NFD", x) if not unicodedata.combining(ch))
    return s.map(lambda x: x if x is None else bare(x))


def doi(c: Column) -> Column:
    """One spelling for a DOI: no prefix, no white space, no final punctuation, lower case; null if missing."""
    x = strip(fold_width(c))
    x = F.when(~F.lower(x).isin(*S.MISSING), x)
    x = F.regexp_replace(x, r"(?i)^(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)", "")
    x = F.lower(F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", ""), r"[.,;]+$", ""))
    return F.when(x != "", x)


def title_key(c: Column) -> Column:
    x = F.regexp_replace(F.lower(fold_width(c)), "[^a-z0-9]+", "")
    return F.when(~is_missing(c) & (x != ""), x)


def year_key(c: Column) -> Column:
    """A whole finite number as text, else null."""
    x = c.try_cast("double")
    return F.when((x == F.floor(x)) & ~F.isnan(x) & (F.abs(x) < 1e15), x.cast("bigint").cast("string"))


def pieces(c: Column, by: str = ";") -> Column:
    """Trimmed parts that are not empty; [] for null."""
    parts = F.filter(F.transform(F.split(c, by, -1), strip), lambda p: p != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def authors_scopus(c: Column) -> Column:
    return F.array_join(pieces(c), "; ")


def authors_wos(c: Column) -> Column:
    """Parted by ';', else by ',', else one; white space collapsed; '' for missing."""
    x = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(x.contains(";"), F.array_join(pieces(x, ";"), "; ")).when(x.contains(","), F.array_join(pieces(x, ","), "; ")).otherwise(x)


def without_ids(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"\s*\(\d+\)", ""), r"(?U)\s+", " "))


def reference_count(c: Column) -> Column:
    """References parted by ';': 0 for a blank cell, null for a missing one."""
    return F.when(c.isNull(), None).when(strip(c) == "", 0).when(is_missing(c), None).otherwise(F.size(pieces(c))).cast("bigint")


def chosen_authors(full: Column, short: Column) -> Column:
    """Full names where a row has usable ones, else the abbreviated ones."""
    usable = ~is_missing(full) & (F.size(pieces(full)) > 0)
    return F.when(usable, full).otherwise(short)


def doc_type(c: Column) -> Column:
    return lookup(F.lower(strip(c)), S.DOC_TYPES, F.lit("Other"))


def source_key(c: Column) -> Column:
    x = F.replace(F.replace(F.replace(F.lower(c), F.lit(" & "), F.lit(" and ")), F.lit("&"), F.lit("and")), F.lit("-"), F.lit(" "))
    return strip(F.regexp_replace(x, r"(?U)[^\w\s]", ""))


def _capital(w: str, first: bool) -> str:
    low = w.lower()
    return low.upper() if low in S.ACRONYMS else low if low in S.SMALL_WORDS and not first else low.title()


@F.pandas_udf(T.StringType())
def journal_title(s: pd.Series) -> pd.Series:
    """Words with capitals (after any character that is no letter, too), small words and acronyms apart."""
    said = lambda x: " ".join(_capital(w, i == 0) for i, w in enumerate(x.split()))
    return s.map(lambda x: x if x is None else said(x))


def truncate(c: Column, n: int) -> Column:
    """The first n characters, and dots where there are more."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def tidy_punctuation(c: Column) -> Column:
    x = c
    for pattern, by in ((r"(?i)\.\s+(of|the|a|an)\b", " $1"), (r"\.+", "."), (r"\s+\.", "."), (r"\.(\s+|$)", ""), (r"^\)|\($", ""), (r"\s{2,}", " ")):
        x = F.regexp_replace(x, pattern, by)
    return strip(x)


def expand_abbreviations(c: Column) -> Column:
    for short, long in S.ABBREVIATIONS:
        c = F.regexp_replace(c, rf"(?i)\b{short}\b", long)
    return c


def clean_affiliation(c: Column) -> Column:
    x = F.regexp_replace(F.replace(c, F.lit("&amp;"), F.lit("&")), r"\[.*?\]", "")
    return F.regexp_replace(strip(tidy_punctuation(strip_accents(x))), r"\s*,\s*", ", ")


def lookup_key(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"\b(of|the|for|and|an|a)\b", " "), r"\s+", " "))


def search_terms(query: str) -> set[str]:
    """Phrases in quotes, loose words and the words of phrases of a boolean query, without operators."""
    import re

    phrases = [p.lower().strip() for p in re.findall(r'"([^"]+)"', query or "")]
    loose = re.findall(r"[a-z][a-z-]+", re.sub(r'"[^"]+"', " ", (query or "").lower()))
    inner = [w for p in phrases for w in re.findall(r"[a-z][a-z-]+", p)]
    return {t for t in [*phrases, *loose, *inner] if t not in ("and", "or", "not", "near", "title", "abs", "key")}


def list_of(c: Column) -> Column:
    """A list column back from its JSON or literal text."""
    return F.coalesce(F.from_json(c, "array<string>", {"allowSingleQuotes": "true"}), F.array().cast("array<string>"))


def size_class(a: Column, names: tuple[str, str, str] = ("Unknown", "SCP", "MCP")) -> Column:
    n = F.size(F.array_distinct(a))
    return F.when(a.isNull() | (n == 0), names[0]).when(n == 1, names[1]).otherwise(names[2])


def only_eu(a: Column) -> Column:
    return (F.size(a) > 0) & F.forall(a, lambda x: x.isin(*S.EU27))
