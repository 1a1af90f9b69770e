"""Text columns: lossy decoding, comment and white-space clean-up, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlens.functions import fixed

_REPLACEMENT = "�"
_ESCAPE = "﷐"


def decode(content: Column) -> Column:
    """Bytes to text: malformed UTF-8 is dropped, every newline form becomes ``\\n``.

    The JVM marks malformed bytes with U+FFFD. A real U+FFFD in the bytes is escaped first, so that
    only the marks are dropped; the escape character itself is escaped likewise.
    """
    raw = content.cast("string")
    plain = F.replace(F.make_valid_utf8(raw), F.lit(_REPLACEMENT), F.lit(""))
    escaped = F.replace(raw, F.lit(_ESCAPE), F.lit(_ESCAPE + "a"))
    escaped = F.replace(escaped, F.lit(_REPLACEMENT), F.lit(_ESCAPE + "b"))
    kept = F.replace(F.make_valid_utf8(escaped), F.lit(_REPLACEMENT), F.lit(""))
    kept = F.replace(kept, F.lit(_ESCAPE + "b"), F.lit(_REPLACEMENT))
    kept = F.replace(kept, F.lit(_ESCAPE + "a"), F.lit(_ESCAPE))
    has_real_mark = F.contains(content, F.lit(_REPLACEMENT.encode()))
    return F.regexp_replace(F.when(has_real_mark, kept).otherwise(plain), r"\r\n?", "\n")


def _drop(text: Column, lang: Column, families) -> Column:
    result = None
    for pattern, languages in families:
        condition, value = lang.isin(*languages), F.regexp_replace(text, pattern, "")
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result.otherwise(text)


def strip_comments(text: Column, lang: Column) -> Column:
    """Remove block comments, then line comments. Strings are not looked at."""
    return _drop(_drop(text, lang, fixed.BLOCK_COMMENTS), lang, fixed.LINE_COMMENTS)


def trim_space(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(fixed.SPACES))


def collapse_whitespace(text: Column, mode: Column) -> Column:
    """``none`` keeps the text, ``moderate`` allows three newlines, all else is aggressive.

    Aggressive: no white space at the end of a line, no empty line, none at either end of the text.
    """
    lines = F.transform(F.split(text, "\n"), lambda line: F.rtrim(line, F.lit(" \t")))
    tight = trim_space(F.array_join(F.filter(lines, lambda line: line != ""), "\n"))
    moderate = F.regexp_replace(text, r"\n{4,}", "\n\n\n")
    return F.when(mode == "none", text).when(mode == "moderate", moderate).otherwise(tight)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def fixed_point(value: Column, digits: int) -> Column:
    """A double with fixed digits, rounded half to even on its exact binary value.

    Decimal casts and ``%.1f`` round the shortest decimal form instead, which moves 1.15 to 1.2. The
    fraction is scaled by a power of two, which is exact, and rounded in whole numbers; ``tail`` is
    what is left of it below the unit.
    """
    unit, scale = 2**48, 10**digits
    size = F.abs(value.cast("double"))
    whole = F.floor(size)
    scaled = (size - whole) * F.lit(float(unit))
    units = F.floor(scaled)
    tail = (scaled - units) * scale
    down = F.shiftright(units * scale, 48)
    to_half = unit // 2 - (units * scale - F.shiftleft(down, 48))
    up = (tail > to_half) | ((tail == to_half) & (down % 2 == 1))
    total = whole * scale + down + up.cast("bigint")
    fraction = F.lpad((total % scale).cast("string"), digits, "0")
    number = F.concat(F.floor(total / scale).cast("string"), F.lit("."), fraction)
    return F.when(value < 0, F.concat(F.lit("-"), number)).otherwise(number)


def run_key(ts: Column) -> Column:
    """Run key in whole seconds."""
    return F.date_format(ts, "yyyy-MM-dd_HHmmss")
