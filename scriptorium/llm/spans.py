"""Spans of regular expressions by built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start: int, rank: int, kind: string, end: int>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def find_spans(text: Column, regex: str, kind: str, rank: int, keep: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """Leftmost non-overlapping matches of regex (never empty ones) that `keep` (of match and its group) accepts, as code
    points. The pieces between matches and the matches themselves, in turn, give the positions."""
    found = [F.regexp_extract_all(text, F.lit(regex), F.lit(g)) for g in ([0, group] if group else [0])]
    turns = F.arrays_zip(F.split(text, regex, -1).alias("gap"), *[x.alias(name) for x, name in zip(found, ("hit", "part"), strict=False)])
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def turn(done: Column, x: Column) -> Column:
        begin = done["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        new = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull() & keep(x["hit"], x["part" if group else "hit"]), F.concat(done["out"], new)).otherwise(done["out"]).alias("out"))

    return F.aggregate(turns, start, turn, lambda done: done["out"])


def written(spans: Column) -> Column:
    """kind:start:end by start, then rank, joined by commas."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
