"""String helpers that the other functions share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = "[ \\t\\n\\x0B\\f\\r]+"


def blank(c: Column) -> Column:
    """Null as the empty string: the missing marker of every text function here."""
    return F.coalesce(c, F.lit(""))


def normalise_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(blank(c), GAP, " "))


def remove_lines(c: Column) -> Column:
    return F.regexp_replace(blank(c), "[\\r\\n]", "")


def remove_sign(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(blank(c), "[^\\p{L}\\p{N}]", "")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(blank(c), "^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+\\z", "")


def limited(c: Column, most: int, length: int = 0) -> Column:
    """The first `most` characters, or `length` of them where 0 < length < most."""
    return F.substring(c, 1, length if 0 < length < most else most)


def similarity(a: Column, b: Column) -> Column:
    """1 - levenshtein / longer length, of letters and digits; 0 where both are empty."""
    x, y = remove_sign(a), remove_sign(b)
    longest = F.greatest(F.char_length(x), F.char_length(y))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def let(c: Column, use) -> Column:
    """use(c) with c evaluated once, where an expression would repeat it many times."""
    return F.get(F.transform(F.array(c), use), 0)


def built_once(make: Callable) -> Callable:
    """make(names and options) with its result kept for the process.

    An expression over column names belongs to no table, and large ones take thousands of calls to the JVM to put together.
    """
    kept: dict = {}

    @wraps(make)
    def get(*args):
        key = (id(SparkContext._gateway), args)
        if key not in kept:
            kept[key] = make(*args)
        return kept[key]

    return get
