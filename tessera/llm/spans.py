"""Places of pattern matches in whole texts, as column expressions.

Patterns are written with possessive repetition, so that a long run costs no stack and
no second look.  A match is found together with the gap before it; places are the running
sums of both lengths, in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers summed one by one; longer lists are summed by blocks of so many.
_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda done, x: done + x)


def before(numbers: Column) -> Column:
    """For each number the sum of those before it; block by block, so not quadratic."""
    block = F.lit(_BLOCK)

    def with_blocks(x: Column) -> Column:
        count = F.ceil(F.size(x) / block).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count - 1), lambda b: total(F.slice(x, b * block + 1, block)))
        starts = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        return let(
            starts,
            lambda s: F.transform(
                x,
                lambda _, i: s[F.floor(i / block).cast("int")]
                + total(F.slice(x, F.floor(i / block).cast("int") * block + 1, i % block)),
            ),
        )

    return let(numbers, lambda x: F.when(F.size(x) == 0, x).otherwise(with_blocks(x)))


def find(text: Column, pattern: str, likely: Column, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs of start, end, value and (a group's) part.

    ``likely`` is a cheap test that must hold for texts with a match.
    """
    gap = rf"\G((?s:.*?))({pattern})"
    no_strings = F.array().cast("array<string>")

    def all_of(index: int) -> Column:
        return F.when(likely, F.regexp_extract_all(text, F.lit(gap), F.lit(index))).otherwise(no_strings)

    part = all_of(2 + group) if group else F.lit(None).cast("array<string>")
    found = F.arrays_zip(all_of(1).alias("gap"), all_of(2).alias("value"), (part if group else all_of(2)).alias("part"))

    def placed(m: Column) -> Column:
        steps = F.transform(m, lambda x: F.length(x["gap"]) + F.length(x["value"]))
        return let(
            before(steps),
            lambda at: F.transform(
                m,
                lambda x, i: F.struct(
                    (at[i] + F.length(x["gap"])).alias("start"),
                    (at[i] + F.length(x["gap"]) + F.length(x["value"])).alias("end"),
                    x["value"].alias("value"),
                    x["part"].alias("part"),
                ),
            ),
        )

    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.transform(m, _no_span)))


def _no_span(m: Column) -> Column:
    return F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), m["value"].alias("value"), m["part"].alias("part"))


def of_kind(spans: Column, kind: str, rank: int) -> Column:
    """Spans marked with their kind and its place in the order of kinds."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")
        ),
    )


def ordered(*lists: Column) -> Column:
    """All spans by start, then kind."""
    return F.array_sort(reduce(lambda a, b: F.concat(a, b), lists))


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check; meant for short ones."""

    def weighted(i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    return (F.length(number) > 0) & (total(F.transform(F.sequence(F.lit(0), F.length(number) - 1), weighted)) % 10 == 0)
