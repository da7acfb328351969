"""python -m tallymark COMMAND: rules | count | build DIR | answers DIR | report DIR | board DIR | page DIR | digest | probes | finger

rules    the published rules and their alternatives
count    counts of the text on standard input, under every rule
build    write the item set and its manifest
answers  write the baselines' answers
report   grade the baselines and the recordings in DIR/responses, write DIR/report.json, print the board
board    print the board of DIR/report.json
page     write DIR/index.html from DIR/report.json
digest   SHA-256 over all prompts, in order
probes   every count of the probe texts, as JSON
finger   SHA-256 over the canonical form of all that the engine counts and scores of the item set and the probes
"""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import counters
from .functions.probes import PROBES
from .operators import compose, fingerprint, items, recorded, report
from .sources import files

COMMANDS = ("rules", "count", "build", "answers", "report", "board", "page", "digest", "probes", "finger")


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tallymark").getOrCreate()


def rules() -> str:
    """The rules as text."""
    out = []
    for d in sorted(counters.EXPLANATIONS):
        out += [f"[{d}] published dialect: {counters.PUBLISHED[d]}", counters.explain(d), f"  alternatives: {', '.join(counters.alternatives(d))}", ""]
    return "\n".join(out)


def dialect_spread(df, text: str = "text"):
    """Rows with the counts of each dimension as a map and their spread."""
    wide = counters.with_counts(df, text)
    for d in counters.COUNTED:
        names = [f"{d}_{k}" for k in counters.DIALECTS[d]]
        wide = wide.withColumn(f"{d}_spread", F.array_max(F.array(*names)) - F.array_min(F.array(*names)))
    return wide


def build_report(spark: SparkSession, folder: str) -> dict:
    """Grade the baselines and the accepted recordings."""
    own = items.build(spark)
    answers, recordings = compose.baselines(own), None
    kinds = [(s, "baseline", i) for i, s in enumerate(compose.SYSTEMS)]
    for (name,) in files.available(spark, f"{folder}/responses").collect():
        rows = recorded.last_of_each(files.read_recorded(spark, f"{folder}/responses/{name}.jsonl"))
        answers = answers.unionByName(recorded.accept(rows, own))
        recordings = rows if recordings is None else recordings.unionByName(rows)
        kinds.append((name, "model", len(kinds)))
    tables = report.evaluate(own, answers, spark.createDataFrame(kinds, "system string, kind string, ord int"), recordings)
    return report.nested(report.as_dict(tables), manifest(own))


def manifest(own) -> dict:
    """What a set of items is: seed, count, families and their targets, rules, and a digest over all prompts."""
    digest = items.ordered_digest(own).first()
    return {
        "seed": items.v.SEED, "count": digest["items"],
        "families": {r["family"]: {"n": r["n"], "targets": [r["min_target"], r["max_target"]]} for r in items.families(own).collect()},
        "published_rules": counters.PUBLISHED, "dialects": {k: list(x) for k, x in counters.DIALECTS.items()}, "prompts_sha256": digest["sha256"],
    }


def main(argv: list[str]) -> int:
    """Run a command; 2 for one that does not exist."""
    if not argv or argv[0] not in COMMANDS or (argv[0] in ("build", "answers", "report", "board", "page") and len(argv) < 2):
        print(__doc__.strip(), file=sys.stderr)
        return 2
    command, folder = argv[0], argv[1] if len(argv) > 1 else ""
    if command == "rules":
        print(rules())
    elif command in ("board", "page"):
        with open(f"{folder}/report.json", encoding="utf-8") as f:
            made = json.load(f)
        if command == "board":
            print(report.as_text(made))
        else:
            with open(f"{folder}/index.html", "w", encoding="utf-8") as f:
                f.write(report.as_page(made))
    elif command == "count":
        row = dialect_spread(files.text_frame(_spark(), sys.stdin.read())).first()
        for d in sorted(counters.COUNTED):
            counts = {k: row[f"{d}_{k}"] for k in counters.DIALECTS[d]}
            print(f"{d:<11} {counts[counters.PUBLISHED[d]]:>5} under {counters.PUBLISHED[d]:<18} spread {row[f'{d}_spread']:>3}  {counts}")
    elif command == "build":
        made = items.build(_spark())
        files.write_items(made, f"{folder}/problems.jsonl")
        files.write_report(_spark(), manifest(made), f"{folder}/dataset.json")
    elif command == "answers":
        files.write_answers(compose.baselines(items.build(_spark())), f"{folder}/answers")
    elif command == "report":
        os.makedirs(folder, exist_ok=True)
        made = build_report(_spark(), folder)
        files.write_report(_spark(), made, f"{folder}/report.json")
        print(report.as_text(made))
    elif command == "digest":
        print(items.ordered_digest(items.build(_spark())).first()["sha256"])
    elif command == "finger":
        print(fingerprint.digest(fingerprint.payload(_spark())))
    else:
        rows = counters.with_counts(_spark().createDataFrame(list(PROBES), "label string, text string")).collect()
        print(json.dumps([r.asDict() for r in rows], ensure_ascii=False, sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
