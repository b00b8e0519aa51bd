"""Markdown from small results, on the driver. Numbers are formatted by Python, whose rounding the reports are known by."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a result that a report shows at most; larger ones belong in files.
MOST_ROWS = 5000


def markdown_table(df: DataFrame, decimals: int = 2) -> str:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report shows {MOST_ROWS} rows at most")
    cell = lambda v: "" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines) + "\n"


def report(title: str, parts: list[tuple[str, str | DataFrame]]) -> str:
    """A heading, then sections of text or tables."""
    body = [f"## {name}\n\n{markdown_table(x) if isinstance(x, DataFrame) else x}\n" for name, x in parts]
    return f"# {title}\n\n" + "\n".join(body)


def gap_report(gaps: DataFrame, sweep: DataFrame) -> str:
    return report("Evidence gaps", [("Ranked gaps", gaps), ("How the threshold matters", sweep)])


def saturation_text(verdict: dict) -> str:
    state = "Saturated" if verdict["saturated"] else "Not saturated"
    return f"{state}: {verdict['new_in_window']} new of {verdict['total']} in the last {verdict['window']} of {verdict['entities']} ({verdict['per_entity']:.3f} each).\n"


def flow_text(stages: list[dict]) -> str:
    lines = [f"- {s['stage']}: {s['n_in']} - {s['removed']} = {s['n_out']}" for s in stages]
    bad = [s["stage"] for s in stages if s["n_in"] - s["removed"] != s["n_out"]]
    if bad:
        raise ValueError(f"the numbers of {', '.join(bad)} don't add up")
    return "\n".join(lines) + "\n"
