"""Counting and grading on streams.

Both work on one row at a time, so they run unchanged on a stream; answers meet the items, a static table, in a
stream-static join. Windowed tallies tolerate late rows up to a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import counters
from ..operators.grading import grade


def count_stream(texts: DataFrame, text: str = "text") -> DataFrame:
    """A stream of texts with the published count of each dimension."""
    return texts.withColumns({d: counters.count(d, F.col(text)) for d in counters.COUNTED})


def grade_stream(answers: DataFrame, items: DataFrame) -> DataFrame:
    """A stream of answers (id, response, ...) with their verdicts; answers to no item are left out."""
    return grade(answers.join(items, "id"))


def tally_stream(graded: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Per window and family: answers and compliant ones."""
    return (
        graded.withWatermark(time, late)
        .groupBy(F.window(time, window), "family")
        .agg(F.count("*").alias("n"), F.count_if("compliant").alias("compliant"))
    )
