"""Reports: JSON without numbers that aren't finite, CSV ledgers, and one plain HTML page, published as a folder that is never written over."""

from __future__ import annotations

import datetime as dt
import html
import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import evidence
from .sources import publish

#: Points of a drawn path, and rows of a table in a page.
POINTS, ROWS = 500, 200


def clean(value: object) -> object:
    """``value`` as JSON has it: numbers that aren't finite are null, dates are text, arrays lists."""
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, np.ndarray)):
        return [clean(v) for v in (value.tolist() if isinstance(value, np.ndarray) else value)]
    if isinstance(value, (bool, np.bool_)) or value is None:
        return None if value is None else bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return float(value) if math.isfinite(value) else None
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return str(value) if not isinstance(value, DataFrame) else None


def json_text(value: object) -> str:
    return json.dumps(clean(value), ensure_ascii=False, indent=2, allow_nan=False, sort_keys=True)


def finite_json(df: DataFrame) -> DataFrame:
    """(json): a document for each row, in which doubles that aren't finite are null."""
    cols = [F.when(~F.isnan(n) & (F.abs(n) != float("inf")), F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def line(ledger: DataFrame, value: str = "nav") -> str:
    """An SVG line of at most POINTS points of a path's ledger."""
    rows = evidence.thinned(ledger.select(F.lit(1).alias("one"), "date", value), POINTS, "one").orderBy("date").collect()
    if len(rows) < 2:
        return ""
    y = np.asarray([r[value] for r in rows], dtype=float)
    span = float(np.ptp(y)) or 1.0
    points = " ".join(f"{700 * k / (len(y) - 1):.1f},{200 - 190 * (v - y.min()) / span:.1f}" for k, v in enumerate(y))
    return f'<svg viewBox="0 0 700 210" role="img"><polyline fill="none" stroke="currentColor" points="{points}"/></svg>'


def table(rows: list[dict]) -> str:
    if not rows:
        return ""
    names = list(dict.fromkeys(k for r in rows for k in r))
    cell = lambda v: html.escape(f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v))
    body = "".join("<tr>" + "".join(f"<td>{cell(r.get(n))}</td>" for n in names) + "</tr>" for r in rows[:ROWS])
    more = f"<p>{len(rows) - ROWS} more rows are in the tables.</p>" if len(rows) > ROWS else ""
    return "<table><tr>" + "".join(f"<th>{html.escape(n)}</th>" for n in names) + f"</tr>{body}</table>{more}"


def page(title: str, statements: list[str], sections: dict[str, str], limits: list[str]) -> str:
    """One page: statements, sections that are HTML already, and what the results don't cover."""
    items = lambda some: "".join(f"<li>{html.escape(s)}</li>" for s in some)
    body = "".join(f"<h2>{html.escape(n)}</h2>{s}" for n, s in sections.items())
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><style>body{{max-width:60rem;margin:2rem auto;font:16px/1.5 sans-serif}}td,th{{padding:.3rem .6rem;border-bottom:1px solid #ccc;text-align:left}}</style><h1>{html.escape(title)}</h1><ul>{items(statements)}</ul>{body}<h2>Limits</h2><ul>{items(limits)}</ul></html>'


def shown(df: DataFrame) -> str:
    """A table of a page: the first rows, for reading; the whole is published beside it."""
    return table([clean(r.asDict(recursive=True)) for r in df.limit(ROWS + 1).collect()])


def save_report(report, target: str, title: str = "Portfolio report") -> str:
    """A run's report: report.json, report.html, ledger and transactions as CSV, its other tables as Parquet."""
    rows = {k: v for k, v in report.rows.items()}
    body = {"status": report.status, "reference": report.reference, "selected": report.selected, "rows": rows, "facts": {k: v for k, v in report.facts.items() if k != "holding"},
        "warnings": report.warnings, "conclusions": report.conclusions}
    sections = {"Value": line(report.tables["ledger"])} if "ledger" in report.tables else {}
    sections |= {n: shown(report.tables[n]) for n in ("risk", "held_out", "rebalancing", "stress") if n in report.tables}
    texts = {"report.json": json_text(body), "report.html": page(title, report.conclusions, sections, report.warnings)}
    flat = {n: df.drop("weights", "roots") for n, df in report.tables.items()}
    return publish(flat, {"title": title, "status": report.status}, target, texts, {n: "csv" for n in ("ledger", "transactions") if n in flat})


def save_demand(events: DataFrame, ledger: DataFrame, summary: DataFrame, target: str) -> str:
    """Dated cash needs: the daily ledger as CSV, a folder for each scenario, events and summary as JSON, a page."""
    tables = {"events": events, "summary": summary}
    texts = {"report.html": page("Dated cash needs", [], {"Summary": shown(summary)},
        ["Conditional on the declared inputs; unknown events change no balance.", "Nothing is sold that wasn't planned."])}
    for r in ledger.select("scenario").distinct().collect():  # at most ten
        tables[f"ledger-{r['scenario']}"] = ledger.where(F.col("scenario") == r["scenario"])
    return publish(tables, {"title": "cash_demand"}, target, texts, {n: "csv" if n.startswith("ledger-") else "json" for n in tables})


#: For a page's tables: a row stays if it holds what is typed, a click on a heading sorts by its column, and what is shown can be saved as CSV.
HANDLING = """<script>
for (const table of document.querySelectorAll("table")) {
  const rows = () => [...table.rows].slice(1), text = (row, k) => row.cells[k].textContent;
  const bar = document.createElement("p"), sought = document.createElement("input"), save = document.createElement("button");
  sought.placeholder = "filter"; save.textContent = "save as CSV"; bar.append(sought, " ", save); table.before(bar);
  sought.oninput = () => rows().forEach(row => { row.hidden = !row.textContent.toLowerCase().includes(sought.value.toLowerCase()); });
  [...table.rows[0].cells].forEach((head, k) => { let up = false; head.onclick = () => {
    up = !up;
    const order = (a, b) => (Number(a) - Number(b) || a.localeCompare(b)) * (up ? 1 : -1);
    rows().sort((a, b) => order(text(a, k), text(b, k))).forEach(row => row.parentNode.append(row));
  }; });
  save.onclick = () => {
    const quoted = cell => '"' + cell.textContent.replaceAll('"', '""') + '"';
    const csv = [...table.rows].filter(row => !row.hidden).map(row => [...row.cells].map(quoted).join(",")).join("\n");
    const link = document.createElement("a");
    link.href = URL.createObjectURL(new Blob([csv], {type: "text/csv"})); link.download = "table.csv"; link.click();
  };
}
</script>"""


def save_exposure(exposures: DataFrame, unknown: DataFrame, rollups: DataFrame, target: str) -> str:
    texts = {"report.html": page("Exposure", [], {"By level": shown(rollups), "Unknown": shown(unknown) + HANDLING},
        ["Declared amounts joined to disclosures of other days; unknown is kept, not spread."])}
    return publish({"exposures": exposures, "unknown": unknown, "rollups": rollups}, {"title": "exposure"}, target, texts, {"unknown": "json", "rollups": "json"})


def save_evaluation(result: dict, target: str) -> str:
    """A rolling evaluation: folds as JSON, the ledgers of both paths as CSV, a page."""
    body = {k: v for k, v in result.items() if k != "ledger"}
    texts = {"evaluation.json": json_text(body),
        "report.html": page("Rolling evaluation", [], {"Folds": table([clean(f) for f in result["folds"]])}, ["One run is no correction for many trials and no proof of control."])}
    ledger = result["ledger"]
    return publish({p: ledger.where(F.col("path") == p) for p in ("actual", "baseline")}, {"title": "evaluation"}, target, texts, {"actual": "csv", "baseline": "csv"})


def save_review(spec: dict, result: dict, target: str, title: str = "Review", method: str = "review/1.0") -> str:
    """A small result with its input: input.json, result.json, report.html and a receipt that binds them."""
    from .sources import digest

    bound = {**clean(result), "input_digest": digest(clean(spec)), "method": result.get("method", method)}
    texts = {"input.json": json_text(spec), "result.json": json_text(bound),
        "report.html": page(title, [str(result.get("conclusion", ""))], {"Result": table([{"field": k, "value": v} for k, v in bound.items() if not isinstance(v, (dict, list))])},
            [str(x) for x in result.get("limits", [])])}
    return publish({}, {"title": title, "input_digest": bound["input_digest"], "method": bound["method"]}, target, texts)
