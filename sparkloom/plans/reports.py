"""Reports of evaluations and comparisons: small results collected once, written as JSON and as Markdown.

A report is a mapping of sections; a section is one record or a list of records.  What is collected is bounded by
sides, categories, anomalies and tensors of one model, never by questions: of those whose verdict
flips, a report names the first ``most`` and counts all.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.sharded import put
from . import compare, scoring

Report = Mapping[str, Any]


def rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def evaluation(items: DataFrame, most: int = 1000) -> Report:
    """Of paired and judged items: rates, categories, anomalies of both sides, times and flips."""
    out: dict[str, Any] = {"summary": rows(scoring.summary(items))[0], "categories": rows(scoring.by_category(items).orderBy("category"))}
    for side in ("source", "candidate"):
        out[f"{side}_anomalies"] = rows(scoring.anomaly_breakdown(items, f"{side}_anomalies"))
        if f"{side}_gen_s" in items.columns:
            out[f"{side}_times"] = rows(scoring.timings(items, f"{side}_gen_s"))[0]
    out["flips"] = [r.id for r in scoring.flips(items).orderBy("id").limit(most).collect()]
    return out


def choice(runs: DataFrame, source: str) -> Report:
    """Of multiple-choice runs: scores and gates of every side, and its anomalies."""
    scores = scoring.gate(scoring.choice_scores(runs), source).orderBy("side")
    return {"source": source, "sides": rows(scores), "passed": all(r["passed"] for r in rows(scores.where(F.col("side") != source)))}


def comparison(compared: DataFrame) -> Report:
    """Of ``compare.tensor_stats``: counts, and a record for each tensor."""
    return {"summary": rows(compare.summarised(compared))[0], "tensors": rows(compared.orderBy("key"))}


def to_json(report: Report) -> str:
    return json.dumps(report, indent=2, sort_keys=True, default=str, ensure_ascii=False)


def _cell(v: Any) -> str:
    return "" if v is None else f"{v:g}" if isinstance(v, float) else str(v).replace("|", "\\|")


def _table(records: Sequence[Mapping[str, Any]]) -> list[str]:
    names = list(dict.fromkeys(k for r in records for k in r))
    return ["| " + " | ".join(x) + " |" for x in [names, ["---"] * len(names), *[[_cell(r.get(n)) for n in names] for r in records]]]


def to_markdown(report: Report, title: str) -> str:
    """A heading for each section; records become tables, single values lines."""
    out = [f"# {title}"]
    for name, section in report.items():
        out += ["", f"## {name.replace('_', ' ')}", ""]
        if isinstance(section, Mapping):
            out += [f"- {k}: {_cell(v)}" for k, v in section.items()]
        elif isinstance(section, list) and section and isinstance(section[0], Mapping):
            out += _table(section)
        else:
            out.append(", ".join(map(_cell, section)) if isinstance(section, list) else _cell(section))
    return "\n".join(out) + "\n"


def write(report: Report, folder: str, name: str, title: str) -> None:
    """``name``.json and ``name``.md in a folder of any store."""
    put(folder, f"{name}.json", to_json(report).encode())
    put(folder, f"{name}.md", to_markdown(report, title).encode())
