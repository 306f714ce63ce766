"""String functions as Columns. Only Unicode folding and the typo ratio need Python, as Arrow UDFs."""
from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nullness import is_diff_null, strip

#: The patterns of string columns in order of precedence, each with its least share of matches.
PATTERNS: tuple[tuple[str, str, float], ...] = (
    ("uuid", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", 0.8),
    ("email", r"[\w.+\-]+@[\w\-]+\.[a-zA-Z]{2,}", 0.8),
    ("url", r"https?://\S+", 0.8),
    ("date_iso", r"\d{4}-\d{2}-\d{2}", 0.8),
    ("datetime_iso", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}", 0.8),
    ("phone", r"\+?[\d\s\-(]{7,20}", 0.7),
    ("zip_us", r"\d{5}(-\d{4})?", 0.8),
    ("integer_str", r"-?\d+", 0.8),
    ("float_str", r"-?\d+\.\d+", 0.8),
    ("boolean_str", r"(?i)(true|false|yes|no|1|0)", 0.9),
    ("json_object", r"(?s)\s*\{.*\}\s*", 0.7),
    ("json_array", r"(?s)\s*\[.*\]\s*", 0.7),
)


def full_match(c: Column, pattern: str) -> Column:
    """The whole string matches; \\w and \\s by Unicode."""
    return c.rlike(rf"(?U)\A(?:{pattern})\z")


def email(c: Column) -> Column:
    """Stripped and lower-cased; null for null, empty and "nan". An @ isn't asked for."""
    s = F.lower(strip(c.cast("string")))
    return F.when(~s.isin("", "nan"), s)


def phone(c: Column) -> Column:
    """7 to 15 digits without an extension and a leading 00; else null."""
    s = strip(c.cast("string"))
    s = F.when(F.lower(s) != "nan", s)
    s = strip(F.regexp_replace(s, r"(?i)(ext|extension|x)\s*\d+\z", ""))
    digits = F.regexp_replace(F.when(s.startswith("00"), F.substr(s, F.lit(3))).otherwise(s), r"\D+", "")
    return F.when(F.length(digits).between(7, 15), digits)


def fold_text(v: str | None) -> str:
    """NFKC, case folding, NFKD without marks; runs of anything but letters and numbers become one blank."""
    if v is None or v.strip().lower() == "nan":
        return ""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", v).casefold())
    s = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in s if not unicodedata.combining(c))
    return " ".join(s.split())


@F.pandas_udf(T.StringType())
def _fold(v: pd.Series) -> pd.Series:
    return v.map(fold_text)


def normal_text(c: Column) -> Column:
    """fold_text of a column; ASCII strings stay in the JVM."""
    s = c.cast("string")
    plain = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    plain = F.when(F.lower(F.trim(s)) == "nan", "").otherwise(plain)
    return F.when(s.isNull(), "").when(s.rlike(r"\A[\x00-\x7F]*\z"), plain).otherwise(_fold(s))


def ascii_text(c: Column) -> Column:
    """normal_text for columns known to be ASCII: built-in functions only."""
    s = c.cast("string")
    return F.when(s.isNull() | (F.lower(F.trim(s)) == "nan"), "").otherwise(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))


def tokens(text: Column) -> Column:
    """Words of a normalised text."""
    return F.array_remove(F.split(text, " "), "")


def shingles(text: Column, size: int, family: str = "generic") -> Column:
    """Of a normalised text: its words (size 1), word n-grams (addresses with blanks) or character n-grams without blanks."""
    words = tokens(text)
    if size <= 1:
        return words
    whole = F.when(text == "", F.array().cast("array<string>"))
    joined = F.replace(text, F.lit(" "), F.lit(""))
    chars = F.when(F.length(joined) <= size, F.array(joined)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(joined) - (size - 1), F.lit(1))), lambda i: F.substr(joined, i, F.lit(size))))
    if family != "address":
        return whole.otherwise(chars)
    grams = F.when(F.size(words) <= size, F.array(F.array_join(words, " "))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " ")))
    return whole.when(F.contains(text, F.lit(" ")), grams).otherwise(chars)


def is_cross_script(a: Column, b: Column) -> Column:
    """One side has Latin letters only and the other has letters of another script."""
    latin, other = r"\p{IsLatin}", r"[\p{L}&&[^\p{IsLatin}]]"
    return (a.rlike(latin) & b.rlike(other)) | (b.rlike(latin) & a.rlike(other))


def abstract_format(c: Column, legacy: bool = True) -> Column:
    """Digits as D, ASCII letters as A. legacy: the letters come second, so the Ds of digits become As as well."""
    s = c.cast("string")
    if legacy:
        return F.regexp_replace(F.regexp_replace(s, "[0-9]", "D"), "[a-zA-Z]", "A")
    return F.regexp_replace(F.regexp_replace(s, "[a-zA-Z]", "A"), "[0-9]", "D")


def domain(c: Column) -> Column:
    """After the first @, else the host of a url; leading w and . go."""
    s = strip(c.cast("string"))
    after = F.lower(strip(F.regexp_replace(s, r"(?s)\A[^@]*@", "")))
    host = F.lower(F.regexp_extract(s, r"\A(?:[^:/?#]*://)?([^/?#]*)", 1))
    return F.when(s.isNull() | (s == ""), "").when(F.contains(s, F.lit("@")), after).otherwise(F.regexp_replace(host, r"\A[w.]+", ""))


def area_code(c: Column) -> Column:
    return F.coalesce(F.substr(phone(c), F.lit(1), F.lit(3)), F.lit(""))


def year(c: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\D", "")
    return F.when(F.length(digits) >= 4, F.substr(digits, F.lit(1), F.lit(4))).otherwise("")


def exact_normal(c: Column) -> Column:
    """The e-mail form, which any text has; else the phone, else the text."""
    return F.coalesce(email(c), phone(c), ascii_text(c))


def sorted_token_prefix(text: Column) -> Column:
    """The first four words in order of a normalised text."""
    return F.array_join(F.slice(F.array_sort(tokens(text)), 1, 4), " ")


def prefix(text: Column) -> Column:
    """The first six characters without blanks of a normalised text."""
    return F.substr(F.replace(text, F.lit(" "), F.lit("")), F.lit(1), F.lit(6))


def block_transform(c: Column, kind: str, ascii_only: bool = False) -> Column:
    """One of the block transforms; an unknown kind is the prefix."""
    text = (ascii_text if ascii_only else normal_text)(c)
    own = {"domain": domain, "area_code": area_code, "year": year, "exact_normalized": exact_normal}
    if kind in own:
        return F.coalesce(own[kind](c), F.lit(""))
    return sorted_token_prefix(text) if kind == "sorted_token_prefix" else prefix(text)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as multisets."""
    times = lambda x, k: F.size(F.filter(x, lambda y: y == k))
    both = F.array_union(a, b)
    low = F.aggregate(both, F.lit(0), lambda s, k: s + F.least(times(a, k), times(b, k)))
    high = F.aggregate(both, F.lit(0), lambda s, k: s + F.greatest(times(a, k), times(b, k)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(low / high)


@lru_cache(1 << 18)
def ratio(x: str, y: str) -> float:
    return SequenceMatcher(None, x, y).ratio()


@F.pandas_udf(T.DoubleType())
def typo_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; not symmetric, so keep the order of the sides."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def diff_text(c: Column) -> Column:
    """For before/after comparison: nulls of all kinds as one token, else the stripped string."""
    return F.when(is_diff_null(c), "__null__").otherwise(strip(c.cast("string")))


def score_text(c: Column) -> Column:
    """For scoring: stripped, lower-cased, without a final .0; nulls of all kinds as null."""
    s = F.regexp_replace(F.lower(strip(c.cast("string"))), r"\.0\z", "")
    return F.when(~s.isin("nan", "none", "", "empty"), s)


def regex_of(sample: str) -> str:
    """An anchored pattern of one value: digit runs by length, letter runs, all else literally."""
    parts = []
    for m in re.finditer(r"(?P<d>\d+)|(?P<a>[^\W\d_]+)|(?P<o>[\s\S])", sample):
        parts.append(rf"\d{{{len(m[0])}}}" if m["d"] else "[a-zA-Z]+" if m["a"] else re.escape(m[0]))
    return "^" + "".join(parts) + "$"


def number_token(c: Column) -> Column:
    """The first number in a string without commas; null if none."""
    return F.nullif(F.regexp_extract(F.replace(strip(c.cast("string")), F.lit(","), F.lit("")), r"([-+]?\d*\.?\d+)", 1), F.lit(""))


#: SQL functions that Catalyst inlines into queries.
SQL_FUNCTIONS = {
    "abstract_format(v STRING) RETURNS STRING": r"regexp_replace(regexp_replace(v, '[0-9]', 'D'), '[a-zA-Z]', 'A')",
    "normalize_email(v STRING) RETURNS STRING": r"nullif(nullif(lower(regexp_replace(v, '(?U)\\A\\s+|\\s+\\z', '')), ''), 'nan')",
    "normalize_phone(v STRING) RETURNS STRING": (
        r"(SELECT CASE WHEN length(d) BETWEEN 7 AND 15 THEN d END FROM (SELECT regexp_replace(regexp_replace(trim(regexp_replace(trim(v), '(?i)(ext|extension|x)\\s*\\d+\\z', '')), '\\A00', ''), '\\D+', '') AS d))"),
}


def register(spark) -> None:
    """normalize_text (an Arrow UDF), abstract_format, normalize_email and normalize_phone for SQL in this session."""
    spark.udf.register("normalize_text", _fold)
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
