"""The report: every system graded, its sensitivity and packaging gap, as nested data, text, and a page."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import counters
from ..sources.scratch import written
from . import recorded, scoring
from .grading import answers_of, grade


def evaluate(items: DataFrame, answers: DataFrame, kinds: DataFrame, recordings: DataFrame | None = None) -> dict[str, DataFrame]:
    """All result tables of a set of systems.

    ``answers`` has (system, id, response), ``kinds`` (system, kind, ord), ``recordings`` what models' answers were
    recorded with. The tables are aggregates: their size
    depends on the number of systems, families and dialects, not of answers.
    """
    rows = answers_of(items, answers)
    graded = written(grade(rows))  # a dozen tables read it
    scores = scoring.score(graded)
    long = scoring.sensitivity(rows)
    summary = scoring.sensitivity_summary(long)
    worst = scoring.sensitivity_worst(summary)
    board = scoring.leaderboard(scores, kinds.select("system", "ord"))
    noted = {}
    if recordings is not None:
        notes = recorded.notes(recordings)
        open_ = scoring.undetermined(graded, recorded.cut_off(recordings), ["system"])
        noted = {"notes": notes.join(open_.select("system", "undetermined"), "system", "left"), "caveats": scoring.caveats(notes, open_)}
    return noted | {
        "kinds": kinds,
        "detail": scoring.detailed(board, kinds).select("system", "kind", "line"),
        "graded": graded,
        "scores": scores,
        "profiles": scoring.error_profile(graded, ["system"]),
        "profiles_exact": scoring.error_profile(graded, ["system"], F.col("mode") == "exact"),
        "histogram": scoring.histogram(graded, ["system"]),
        "sensitivity": long,
        "summary": summary,
        "worst": worst,
        "packaging": scoring.packaging(rows),
        "board": board,
        "headline": scoring.headline(board, worst, kinds.select("system", "kind")),
    }


def as_dict(tables: dict[str, DataFrame]) -> dict:
    """The result tables, but for the graded rows, as lists of plain dicts: small, so collected."""
    return {k: [r.asDict(True) for r in df.collect()] for k, df in tables.items() if k != "graded"}


def nested(report: dict, dataset: dict) -> dict:
    """The report as data of its own: ``dataset``, ``systems`` in their order with all figures of each, and ``headline``.

    The flat tables stay beside them, for the board and the page.
    """
    of = {k: {r["system"]: r for r in report.get(k, [])} for k in ("packaging", "worst", "profiles", "profiles_exact", "notes", "board")}
    flags = ("n", "compliant", "rate", "count_ok", "keyword_ok", "unique_ok", "empty")
    systems = []
    for k in sorted(report["kinds"], key=lambda r: r["ord"]):
        name, dimensions = k["system"], {}
        for r in report["summary"]:
            if r["system"] == name:
                rates = {x["dialect"]: x["rate"] for x in sorted(report["sensitivity"], key=lambda x: x["pos"]) if (x["system"], x["dimension"]) == (name, r["dimension"])}
                dimensions[r["dimension"]] = {"by_dialect": rates, "published": counters.PUBLISHED[r["dimension"]]} | {x: r[x] for x in ("n", "published_rate", "spread_points", "lowest", "highest")}
        errors = {x: v for x, v in of["profiles_exact"].get(name, {}).items() if x != "system"}
        families = {r["family"]: {f: r[f] for f in flags} for r in report["scores"] if r["system"] == name and r["family"] is not None}
        fixture = {("truncated_undetermined" if x == "undetermined" else x): v for x, v in of["notes"].get(name, {}).items() if x != "system"}
        packed = of["packaging"].get(name, {})
        systems.append({
            "system": name, "kind": k["kind"], "fixture": fixture,
            "strict": {"overall": {f: of["board"][name][f] for f in flags} | {"errors": errors}, "families": families},
            "sensitivity": dimensions | {"worst": {x: v for x, v in of["worst"].get(name, {}).items() if x != "system"}},
        } | {x: packed.get(x) for x in ("lenient_rate", "packaging_gap_points", "responses_unwrapped")})
    told = {k: dataset[k] for k in ("count", "seed", "prompts_sha256", "published_rules")} | {"families": {k: x["n"] for k, x in sorted(dataset["families"].items())}}
    return report | {"dataset": told, "systems": systems}


def _percent(x: float | None) -> str:
    return "-" if x is None else f"{x * 100:.1f}%"


def as_text(report: dict) -> str:
    """The leaderboard, a line a system."""
    exact = {r["system"]: r for r in report["profiles_exact"]}
    worst = {r["system"]: r for r in report["worst"]}
    out = [f"{'system':<18} {'compliant':>9} {'count':>7} {'keyword':>7} {'mean error':>10}  worst rule"]
    for r in sorted(report["board"], key=lambda r: r["place"]):
        e, w = exact.get(r["system"], {}), worst.get(r["system"], {})
        mean = e.get("mean_error")
        moved = f"{w['spread_points']:.1f} points {w['dimension']}" if w.get("dimension") else "none"
        out.append(f"{r['system']:<18} {_percent(r['rate']):>9} {r['count_ok']:>7} {r['keyword_ok']:>7} {'-' if mean is None else format(mean, '+.2f'):>10}  {moved}")
    return "\n".join(out)


def shade(rate: float) -> str:
    """The class of a rate's cell."""
    return "good" if rate >= 0.9 else "poor" if rate < 0.2 else "middling"


def shade_spread(points: float) -> str:
    """The class of a spread's cell, in percentage points."""
    return "poor" if points >= 10 else "middling" if points >= 2 else "good"


def _table(head: list[str], rows: list[list[tuple[str, str]]]) -> str:
    cells = lambda r: "".join(f'<td class="{c}">{html.escape(x)}</td>' for x, c in r)
    return f"<table><tr>{''.join(f'<th>{html.escape(h)}</th>' for h in head)}</tr>{''.join(f'<tr>{cells(r)}</tr>' for r in rows)}</table>"


def _details(report: dict) -> list[str]:
    """A table a dimension: what each rule gives, models first."""
    lines = [r["system"] for r in sorted(report["detail"], key=lambda r: r["line"])]
    rate = {(r["system"], r["dimension"], r["dialect"]): r["rate"] for r in report["sensitivity"]}
    spread = {(r["system"], r["dimension"]): r for r in report["summary"]}
    out = []
    for d in sorted({r["dimension"] for r in report["summary"] if r["system"] in lines}):
        shown = [s for s in lines if (s, d) in spread]
        rows = [
            [(s, "")]
            + [(_percent(rate.get((s, d, k))), "published" if k == counters.PUBLISHED[d] else "") for k in counters.DIALECTS[d]]
            + [(f"{spread[s, d]['spread_points']:.1f}", shade_spread(spread[s, d]["spread_points"]))]
            for s in shown
        ]
        out += [f"<h3>{html.escape(d)}, {spread[shown[0], d]['n']} items</h3>", _table(["system", *counters.DIALECTS[d], "points"], rows)]
    return out


def as_page(report: dict) -> str:
    """A page without scripts: leading figures, leaderboard, compliance by family, spreads by dimension, answers that
    were cut off, what each rule gives, and the published rules."""
    board = sorted(report["board"], key=lambda r: r["place"])
    order = [r["system"] for r in board]
    pooled = {r["system"]: r for r in report["profiles"]}
    first = [
        [(r["system"], ""), (_percent(r["rate"]), shade(r["rate"])), (str(r["count_ok"]), ""), (str(r["keyword_ok"]), "")]
        + [("-" if (m := pooled[r["system"]]["mean_error"]) is None else f"{m:+.2f}", "")]
        for r in board
    ]
    families = sorted({r["family"] for r in report["scores"] if r["family"]})
    of = {(r["system"], r["family"]): r["rate"] for r in report["scores"]}
    second = [[(s, "")] + [(_percent(of.get((s, f))), shade(of.get((s, f), 0.0))) for f in families] for s in order]
    dims = sorted({r["dimension"] for r in report["summary"]})
    spread = {(r["system"], r["dimension"]): r["spread_points"] for r in report["summary"]}
    third = [[(s, "")] + [(f"{spread.get((s, d), 0.0):.1f}", shade_spread(spread.get((s, d), 0.0))) for d in dims] for s in order]
    style = "body{font-family:sans-serif}td,th{padding:2px 8px;text-align:left}.good{background:#dfd}.poor{background:#fdd}.published{font-weight:bold}"
    head, told = report["headline"][0], report.get("dataset", {})
    cards = [
        (str(told.get("count", pooled[order[0]]["n"] if order else 0)), "prompts with a count that can be checked"),
        (_percent(head["filler_keyword_rate"]), "of them are met by filler with the keyword in it"),
        (_percent(head["best_model_rate"]), f"are met by the best model, {head['best_model'] or 'of which there is none'}"),
        (f"{head['largest_spread_points'] or 0:.1f} points", f"are moved by another rule for {head['largest_dimension'] or 'nothing'} ({head['largest_system']})"),
    ]
    caveats = report.get("caveats", [])
    cut = [f"<li><b>{html.escape(r['system'])}</b>: {html.escape(r['caveat'])}</li>" for r in sorted(caveats, key=lambda r: order.index(r["system"]))]
    parts = [
        "<h1>Leaderboard</h1>",
        f"<p>Prompt set <code>{html.escape(told['prompts_sha256'][:16])}</code>, seed {told['seed']}.</p>" if told else "",
        "<ul class=\"cards\">" + "".join(f"<li><b>{html.escape(a)}</b> {html.escape(b)}</li>" for a, b in cards) + "</ul>",
        _table(["system", "compliant", "count", "keyword", "mean error"], first),
        "<h2>Compliance by family</h2>",
        _table(["system", *families], second),
        "<h2>Points that a counting rule moves</h2>",
        _table(["system", *dims], third),
        "<h2>Answers that were cut off</h2>",
        f"<ul>{''.join(cut)}</ul>" if cut else "<p>No recorded answer was cut off.</p>",
        "<h2>Every rule in detail</h2>",
        *_details(report),
        "<h2>The published rules</h2>",
        "<ul>" + "".join(f"<li>{html.escape(d)}: <code>{html.escape(k)}</code></li>" for d, k in sorted(counters.PUBLISHED.items())) + "</ul>",
    ]
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Leaderboard</title><style>{style}</style></head><body>{"".join(parts)}</body></html>\n'
