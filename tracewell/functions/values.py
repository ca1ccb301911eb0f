"""Column expressions for text, times, numbers and paths; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE_CHARS = 300
PREVIEW_CHARS = 240
DAY = 86_400.0


def glob_regex(pattern: str) -> str:
    """An anchored Java regular expression for a shell pattern; ``*`` crosses slashes."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        close = pattern.find("]", k + 1 + (pattern[k : k + 1] == "!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            inside = pattern[k:close].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else r"\^" + inside[1:] if inside[0] == "^" else inside) + "]")
            k = close + 1
        else:
            out.append(re.sub(r"([^A-Za-z0-9_/ ])", r"\\\1", c) if ord(c) < 128 else c)
    return f"(?s)^{''.join(out)}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether the whole path or its last part matches one of the patterns."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for p in patterns:
        rule = glob_regex(p)
        out = out | path.rlike(rule) | name.rlike(rule)
    return out


#: Spellings of one extension.
EXTENSION_SPELLINGS = {".jpe": ".jpg", ".jpeg": ".jpg", ".tif": ".tiff", ".htm": ".html"}


def extension(raw: Column) -> Column:
    """An extension in its usual spelling."""
    low = F.lower(F.trim(raw))
    dotted = F.when((low == "") | low.startswith("."), low).otherwise(F.concat(F.lit("."), low))
    out = dotted
    for a, b in EXTENSION_SPELLINGS.items():
        out = F.when(dotted == a, F.lit(b)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def disk_extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return extension(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]+)$", 1))


def iso_time(epoch: Column, offset_minutes: int = 0) -> Column:
    """ISO 8601 text of epoch seconds with a fixed offset; empty outside the years 1 to 9999."""
    shifted = F.round(epoch, 6) + F.lit(60.0 * offset_minutes)
    sign, rest = ("-" if offset_minutes < 0 else "+"), abs(offset_minutes)
    text = F.date_format(F.timestamp_seconds(F.floor(shifted)), "yyyy-MM-dd'T'HH:mm:ss")
    inside = shifted.between(-62_135_596_800.0, 253_402_300_799.999999)
    return F.when(inside, F.concat(text, F.lit(f"{sign}{rest // 60:02d}:{rest % 60:02d}"))).otherwise("")


def finite(number: Column) -> Column:
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))


def suspicious_time(epoch: Column, now: float) -> Column:
    return (epoch <= 0) | (epoch > now + DAY)


def to_number(text: Column) -> Column:
    """Text as double; null for anything that isn't a finite number."""
    value = text.try_cast("double")
    return F.when(finite(value), value)


def to_whole(text: Column) -> Column:
    return to_number(text).try_cast("long")


def preview(line: Column, start: Column, end: Column, width: int = PREVIEW_CHARS) -> Column:
    """At most ``width`` characters with the match in the middle; dots stand for what was cut."""
    size = F.length(line)
    left = F.greatest(F.lit(0), F.floor((start + end) / 2).cast("int") - width // 2)
    right = F.least(size, left + width)
    left = F.greatest(F.lit(0), right - width)
    shown = F.concat(F.when(left > 0, "…").otherwise(""), F.substring(line, left + 1, F.lit(width)), F.when(right < size, "…").otherwise(""))
    return F.when(size <= width, line).otherwise(shown)


def value_text(value: Column) -> Column:
    """A stored value as text: NULL by name, long values cut with their length."""
    size = F.length(value)
    cut = F.concat(F.left(value, F.lit(VALUE_CHARS)), F.lit("…("), size.cast("string"), F.lit(" chars)"))
    return F.when(value.isNull(), F.lit("NULL")).when(size <= VALUE_CHARS, value).otherwise(cut)


def sidecar_main(path: Column) -> Column:
    """The database that a -wal, -shm or -journal file belongs to; null for other files."""
    return F.when(path.rlike("-(wal|shm|journal)$"), F.regexp_replace(path, "-(wal|shm|journal)$", ""))


#: Characters that start a formula in spreadsheets, and what text is told from one by.
FORMULA_STARTS = ("=", "+", "-", "@", "\t", "\r")
FORMULA_MARK = "'"
#: Text that Python reads as a number, as after digit groups are joined.
NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?|inf(?:inity)?|nan)\s*$"


def escape_formula(text: Column) -> Column:
    """Text that a spreadsheet shows as it is; numbers stay as they are.

    Text that begins with the mark gets another one, so that taking one mark
    away always gives the text back.
    """
    starts = F.substring(text, 1, 1).isin(*FORMULA_STARTS) & ~text.rlike(NUMBER)
    return F.when(text.startswith(FORMULA_MARK) | starts, F.concat(F.lit(FORMULA_MARK), text)).otherwise(text)


def unescape_formula(text: Column) -> Column:
    return F.when(text.startswith(FORMULA_MARK), F.substring(text, 2, 1 << 30)).otherwise(text)


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    bits = F.aggregate(counts, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0))
    return F.greatest(F.coalesce(bits, F.lit(0.0)), F.lit(0.0))
