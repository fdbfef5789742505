"""Reports rendered at the driver from aggregates of one row or a small set."""

from __future__ import annotations

import hashlib
import html
import json
import platform

from pyspark.sql import DataFrame


def audit(cfg, inputs: dict[str, str]) -> str:
    """Parameters, versions and hashes of input paths as JSON."""
    import pyspark

    body = {"parameters": cfg.__dict__, "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__}, "inputs": {k: hashlib.sha256(v.encode()).hexdigest() for k, v in inputs.items()}}
    return json.dumps(body, indent=2, sort_keys=True)


#: A set has a dozen members; a table with more rows than this is no set.
MOST = 1000


def _members(primers: DataFrame) -> list:
    rows = primers.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a report lists at most {MOST} primers")
    return rows


def summary(report: DataFrame) -> dict:
    return report.first().asDict()


def page(title: str, report: DataFrame, primers: DataFrame) -> str:
    """A plain HTML page of the set's figures and members."""
    cell = lambda v: f"{v:.4g}" if isinstance(v, float) else html.escape(str(v))
    figures = "".join(f"<tr><th>{html.escape(k)}</th><td>{cell(v)}</td></tr>" for k, v in summary(report).items())
    names = primers.columns
    body = "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in names) + "</tr>" for r in _members(primers))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in names)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{figures}</table><table><tr>{head}</tr>{body}</table>"


def protocol(primers: DataFrame, polymerase: str, temperature: float) -> str:
    """Markdown of what to mix and how long."""
    names = sorted(r["primer"] for r in _members(primers))
    lines = [f"- {i}. `{p}`" for i, p in enumerate(names, 1)]
    return "\n".join([f"# Amplification with {polymerase}", "", f"Incubate at {temperature:g} degrees.", "", "## Oligos", "", *lines, ""])
