"""One digest over what the engine counts and scores, to tell whether a change moved any of it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import counters as c
from ..functions.probes import PROBES
from . import compose, items, scoring
from .grading import answers_of, grade, keyword_present, unwrap

#: Baselines whose sensitivity is part of it.
SENSITIVE = ("reference", "approximate")


def canonical(data) -> str:
    """JSON in one form: sorted keys, nothing but ASCII, no blanks."""
    return json.dumps(data, sort_keys=True, ensure_ascii=True, separators=(",", ":"))


def digest(data) -> str:
    """SHA-256 of the canonical form."""
    return hashlib.sha256(canonical(data).encode()).hexdigest()


def _probes(spark: SparkSession) -> dict:
    t = F.col("text")
    rows = c.with_counts(spark.createDataFrame(list(PROBES), "label string, text string")).select(
        "*", keyword_present(t, F.lit("yeast")).alias("keyword"), unwrap(t)["notes"].alias("notes"),
        *[c.has_duplicates(c.item_keys(t, c.PUBLISHED["bullets"], k)).alias(f"items_{k}") for k in c.DIALECTS["items"]],
    )
    return {r["label"]: {k: v for k, v in r.asDict().items() if k not in ("label", "text")} for r in rows.collect()}


def _scores(rows) -> list[dict]:
    return sorted((r.asDict() for r in scoring.score(rows).collect()), key=canonical)


def payload(spark: SparkSession) -> dict:
    """All that goes into the digest, as plain data. Aggregates of a fixed item set, so it is small."""
    own = items.build(spark)
    digest_row = items.ordered_digest(own).first()
    rows = answers_of(own, compose.baselines(own))
    # A system that left every fifth item out: what is missing counts as failed.
    some = own.where(F.col("ord") % 5 != 0)
    partial = answers_of(own, compose.baseline(some, "reference"))
    sensitive = scoring.sensitivity(rows.where(F.col("system").isin(*SENSITIVE)))
    return {
        "dataset": {"count": digest_row["items"], "prompts_sha256": digest_row["sha256"], "published_rules": c.PUBLISHED, "dialects": {k: list(x) for k, x in c.DIALECTS.items()}},
        "probes": _probes(spark),
        "baselines": _scores(grade(rows)),
        "partial_coverage": _scores(grade(partial)),
        "sensitivity": sorted((r.asDict() for r in sensitive.collect()), key=canonical),
        "explanations": {d: c.explain(d) for d in sorted(c.EXPLANATIONS)},
    }
