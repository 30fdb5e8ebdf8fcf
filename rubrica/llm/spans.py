"""Spans of pattern matches as columns: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points, end exclusive."""
    expression = F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, expression, F.lit(0))
    empty = F.array().cast(SPAN)
    # The end of a match is the sum of all gaps and matches up to it.
    step = lambda done, x: F.concat(
        done,
        F.array(
            let(
                F.when(F.size(done) == 0, 0).otherwise(F.element_at(done, -1)["end"]) + F.length(x["gap"]),
                lambda at: F.struct(at.alias("start"), (at + F.length(x["match"])).cast("int").alias("end"), x["match"].alias("match")),
            )
        ),
    )
    # The last gap has no match after it.
    paired = lambda found: F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(F.coalesce(F.size(matches), F.lit(0)) <= 0, empty).otherwise(F.aggregate(paired(matches), empty, step))


def replaced(text: Column, spans: Column, mask) -> Column:
    """``text`` with each span (sorted, not overlapping) replaced by ``mask(span)``."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    end = F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(
            F.concat(s["done"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), mask(x)).alias("done"), x["end"].alias("at")
        ),
        lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, end).otherwise(text)
