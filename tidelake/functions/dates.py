"""Dates and times from dirty strings. All timestamps are without time zone."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nullness import strip

#: Date and date-time formats, Java and strftime spelling; year first, then month first, then day first, then names, so that
#: one list serves the guess of a value's format and the reading of it.
FORMATS: tuple[tuple[str, str], ...] = (
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S"), ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
    ("yyyy/MM/dd HH:mm", "%Y/%m/%d %H:%M"), ("yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"), ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "%Y-%m-%dT%H:%M:%S.%f"), ("yyyy-MM-dd'T'HH:mm", "%Y-%m-%dT%H:%M"), ("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy/MM/dd", "%Y/%m/%d"),
    ("MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S"), ("MM-dd-yyyy HH:mm:ss", "%m-%d-%Y %H:%M:%S"), ("MM/dd/yyyy HH:mm", "%m/%d/%Y %H:%M"), ("MM-dd-yyyy HH:mm", "%m-%d-%Y %H:%M"),
    ("MM/dd/yyyy", "%m/%d/%Y"), ("MM-dd-yyyy", "%m-%d-%Y"), ("dd-MM-yyyy HH:mm:ss", "%d-%m-%Y %H:%M:%S"), ("dd/MM/yyyy HH:mm:ss", "%d/%m/%Y %H:%M:%S"),
    ("dd-MM-yyyy HH:mm", "%d-%m-%Y %H:%M"), ("dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"), ("dd-MM-yyyy", "%d-%m-%Y"), ("dd/MM/yyyy", "%d/%m/%Y"),
    ("MMMM d, yyyy", "%B %d, %Y"), ("MMM d, yyyy", "%b %d, %Y"), ("d-MMM-yyyy", "%d-%b-%Y"), ("d-MMMM-yyyy", "%d-%B-%Y"),
)
#: What a date part and a time part of a string look like.
DATE_PART = (r"(?i)\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{2}[-/]\d{1,2}[-/]\d{1,2}\b|"
             r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)")
TIME_PART = r"(?i)\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:am|pm)?\b|\b\d{1,2}\s*(?:am|pm)\b"


def _shape(java: str) -> str | None:
    """What a format's values look like with digits as D; null if month names stand in it."""
    if "MMM" in java:
        return None
    return "".join("D" if ch in "yMdHmsS" else ch for ch in java.replace("'T'", "T"))


def _cut_out(s: Column, java: str) -> Column:
    """The timestamp of a string that has the shape of a format of digits: each field stands at its place. Null if it is no date."""
    plain = java.replace("'T'", "T")

    def field(letter: str, end: str | None = None) -> Column:
        at = plain.find(letter)
        if at < 0:
            return F.lit("0")
        return F.substring(s, at + 1, plain.rfind(end or letter) - at + 1)

    second = field("s", "S" if "S" in plain else None)
    return F.try_make_timestamp_ntz(*(field(x).try_cast("int") for x in "yMdHm"), second.try_cast("decimal(16,6)"))


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_NAME = "(" + "|".join(_MONTHS) + ")[a-z]*\\.?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
#: Free forms of a date and the group of year, month and day in each; a weekday may stand before and a time after it.
_FREE = (
    (r"(\d{4})[-/. ]+(\d{1,2})[-/. ]+(\d{1,2})", (1, 2, 3)), (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)), (rf"{_DAY}[-/., ]+{_NAME},?[-/. ]+(\d{{4}})", (3, 2, 1)),
    (rf"{_NAME}[-/. ]+{_DAY},?[-/. ]+(\d{{4}})", (3, 1, 2)), (rf"(\d{{4}})[-/. ]+{_NAME}[-/. ]+{_DAY}", (1, 2, 3)), (r"(\d{1,2})[-/. ]+(\d{1,2})[-/. ]+(\d{4}|\d{2})", (3, 1, 2)))
_CLOCK = r"(?:[t, ]+(?:at )?(\d{1,2})(?::(\d{2}))?(?::(\d{2}(?:\.\d{1,6})?)\d*)? *([ap])?\.?m?\.?(?: *(?:z|utc|gmt))?)?"


def free_timestamp(c: Column) -> Column:
    """Of a date in free form (1 June 2024, June 1st, 2024 3:05 pm, 2024.06.01, 20240601, 6/1/24): month first where both would fit,
    two-digit years from 1969 to 2068. Null if it is none of these."""
    s = F.lower(F.regexp_replace(strip(c.cast("string")), r"\s+", " "))
    out = None
    for form, (y, m, d) in _FREE:
        rx = rf"\A(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +)?{form}{_CLOCK}\z"
        part = lambda i, rx=rx: F.regexp_extract(s, rx, i)
        whole = lambda i, rx=rx: F.regexp_extract(s, rx, i).try_cast("int")
        month = F.array_position(F.array(*map(F.lit, _MONTHS)), part(m)).cast("int") if form.find("jan") >= 0 else whole(m)
        year = F.when(F.length(part(y)) == 2, whole(y) + F.when(whole(y) < 69, 2000).otherwise(1900)).otherwise(whole(y))
        hour = F.coalesce(whole(4), F.lit(0))
        hour = F.when(part(7) == "p", hour % 12 + 12).when(part(7) == "a", hour % 12).otherwise(hour)
        made = lambda month, day: F.try_make_timestamp_ntz(year, month, day, hour, F.coalesce(whole(5), F.lit(0)), F.coalesce(part(6).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)")))  # noqa: E731, B023
        one = made(month, whole(d))
        if form is _FREE[-1][0]:
            one = F.coalesce(one, made(whole(d), month))
        # an hour alone needs its half of the day
        fits = F.rlike(s, F.lit(rx)) & ((part(4) == "") | (part(5) != "") | (part(7) != ""))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return out


def parse_timestamp(c: Column, formats: tuple[str, ...] | None = None, free: bool = True) -> Column:
    """The first format that fits, else (with free) a date in free form; null if none does. A value's shape picks the formats of digits that
    are tried on it, whose fields are cut out by place."""
    s = strip(c.cast("string"))
    shape = F.translate(s, "0123456789", "D" * 10)
    by_shape: dict[str | None, list[str]] = {}
    for f in formats or [j for j, _ in FORMATS]:
        by_shape.setdefault(_shape(f), []).append(f)
    out = F.when(s.isNull(), F.lit(None).cast("timestamp_ntz"))
    for want, fs in by_shape.items():
        if want is not None:
            out = out.when(shape == want, F.coalesce(*[_cut_out(s, f) for f in fs]))
    named = [F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in by_shape.get(None, [])]
    if free and not formats:
        return out.when(s.rlike("[0-9]"), F.coalesce(*[F.when(s.rlike("(?i)[a-z]{3}"), x) for x in named], free_timestamp(s)))
    return out.when(s.rlike("(?i)[a-z]{3}"), F.coalesce(*named)) if named else out


def has_date(c: Column) -> Column:
    return c.cast("string").rlike(DATE_PART)


def has_time(c: Column) -> Column:
    return c.cast("string").rlike(TIME_PART)


def parse_time(c: Column) -> Column:
    """Canonical HH:mm:ss of a time, or of the time of a date-time; else null."""
    s = strip(c.cast("string"))
    bare = F.regexp_extract(s, r"(?i)\A(\d{1,2}:\d{2}(?::\d{2})?)(?:\.\d+)?\s*(am|pm)?\z", 1)
    half = F.lower(F.regexp_extract(s, r"(?i)\A\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?\s*(am|pm)\z", 1))
    part = lambda i: F.get(F.split(bare, ":"), F.lit(i)).cast("int")
    hour = F.when(half == "pm", part(0) % 12 + 12).when(half == "am", part(0) % 12).otherwise(part(0))
    second = F.coalesce(part(2), F.lit(0))
    fits = (bare != "") & (hour < 24) & (part(1) < 60) & (second < 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(fits, F.concat_ws(":", two(hour), two(part(1)), two(second))).when(bare == "", F.date_format(parse_timestamp(s), "HH:mm:ss"))


def first_date(df: DataFrame, column: str, order: str) -> Column:
    """Aggregate: the first parseable date of a column in row order, as yyyy-MM-dd."""
    c = F.col(column)
    day = F.when(has_date(c), F.date_format(parse_timestamp(c), "yyyy-MM-dd"))
    return F.min_by(day, F.when(day.isNotNull(), F.col(order)))


def complete_dates(df: DataFrame, column: str, order: str) -> DataFrame:
    """Times without a date get the column's first date; done only if the column has both kinds. One row is joined to all."""
    c = F.col(f"`{column}`")
    found = df.agg(first_date(df, column, order).alias("_day"), F.bool_or(has_time(c)).alias("_timed"))
    bare = ~has_date(c) & has_time(c) & F.col("_timed") & F.col("_day").isNotNull()
    out = df.join(F.broadcast(found)).withColumn(column, F.when(bare, F.concat_ws(" ", "_day", strip(c))).otherwise(c))
    return out.drop("_day", "_timed")


def inferred_order() -> list[str]:
    """strftime formats in the order in which a value's format is guessed: as they are read, but day first where day and month can't be told."""
    names = [f for _, f in FORMATS]
    return sorted(names, key=lambda f: (names.index(f.replace("%d", "%D").replace("%m", "%d").replace("%D", "%m")) if f.startswith("%d") and f[3:5] == "%m" else names.index(f), not f.startswith("%d")))


def read_as(sample: str) -> datetime | None:
    """A value by the first format that reads it, month first."""
    for _, f in FORMATS:
        try:
            return datetime.strptime(sample, f)
        except ValueError:
            continue
    return None


def format_of(sample: str) -> str | None:
    """The first strftime format, day first, that writes a value as it stands; the value itself is read month first. So 03/04/2024 is
    the fourth of March, but 04/04/2024 and 31/12/2024 are written day first."""
    text = sample.strip()
    value = read_as(text)
    return next((f for f in inferred_order() if value.strftime(f).lower() == text.lower()), None) if value else None


def java_format(strftime: str) -> str | None:
    return next((j for j, f in FORMATS if f == strftime), None)


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a time-zone-free timestamp."""
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c.cast("bigint")).cast("timestamp_ntz")


def iso_answer(text: str) -> str:
    """A user's date answer as ISO, day first; prefixes as fill_value: go. Unreadable text comes back as it is."""
    s = text.strip()
    for p in ("fill_value:", "fill ", "impute "):
        if s.lower().startswith(p):
            s = s[len(p):].strip()
    for f in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y", "%d-%m-%Y", "%m/%d/%Y"):
        try:
            t = datetime.strptime(s, f)
            return t.strftime("%Y-%m-%d" if "%H" not in f else "%Y-%m-%d %H:%M:%S")
        except ValueError:
            continue
    return s


def clock(c: Column) -> Column:
    """A user's time (8h30, 07:25, 8:00 p.m.) as HH:mm."""
    s = F.lower(F.regexp_replace(strip(c.cast("string")), r"\.", ""))
    rx = r"\A(\d{1,2})(?:[h:](\d{2})?)?(?::\d{2})?\s*(am|pm)?\z"
    h, m, half = (F.regexp_extract(s, rx, i) for i in (1, 2, 3))
    hour = h.try_cast("int")
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    minute = F.coalesce(m.try_cast("int"), F.lit(0))
    return F.when((hour < 24) & (minute < 60), F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), F.lpad(minute.cast("string"), 2, "0")))
