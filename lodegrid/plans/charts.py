"""Charts as SVG from small results, on the driver: bars, stacked bars, heat maps, bubbles."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from lodegrid.plans.reports import MOST_ROWS

CELL, LEFT, TOP = 36, 160, 60
COLOURS = ("#4878a8", "#e08a3c", "#6aa35b", "#c4504d", "#8a6fb0", "#8c6b5d", "#d08ab8", "#7f7f7f", "#b5b34a", "#4fb0bf")


def _collected(df: DataFrame) -> list[tuple]:
    rows = [tuple(r) for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a chart shows {MOST_ROWS} rows at most")
    return rows


def _text(x: float, y: float, s: object, anchor: str = "end", turn: str = "") -> str:
    return f'<text x="{x:g}" y="{y:g}" font-size="11" font-family="sans-serif" text-anchor="{anchor}"{turn}>{escape(str(s))}</text>'


def _svg(title: str, width: float, height: float, marks: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}"><rect width="100%" height="100%" fill="white"/>{_text(8, 20, title, "start")}{"".join(marks)}</svg>\n'


def bars(df: DataFrame, title: str, length: float = 400) -> str:
    """Rows (label, n) in the order of the result, each a bar with its number."""
    rows = _collected(df)
    most = max([n for _, n in rows if n] or [1])
    marks = []
    for k, (label, n) in enumerate(rows):
        y = TOP + 20 * k
        marks += [_text(LEFT - 6, y + 12, label), f'<rect x="{LEFT}" y="{y}" width="{length * n / most:g}" height="15" fill="{COLOURS[0]}"/>', _text(LEFT + length * n / most + 4, y + 12, n, "start")]
    return _svg(title, LEFT + length + 60, TOP + 20 * len(rows) + 20, marks)


def stacked_bars(df: DataFrame, title: str, length: float = 400) -> str:
    """Rows (label, part, n): a bar a label, its parts in sorted order in colours of their own."""
    rows = _collected(df)
    labels, parts = list(dict.fromkeys(r[0] for r in rows)), sorted({r[1] for r in rows}, key=str)
    most = max([sum(n for x, _, n in rows if x == label) for label in labels] or [1]) or 1
    marks = [_text(LEFT + 90 * k + 14, TOP - 14, p, "start") + f'<rect x="{LEFT + 90 * k}" y="{TOP - 24}" width="10" height="10" fill="{COLOURS[k % len(COLOURS)]}"/>' for k, p in enumerate(parts)]
    for k, label in enumerate(labels):
        x, y = float(LEFT), TOP + 20 * k
        marks.append(_text(LEFT - 6, y + 12, label))
        for c, p in enumerate(parts):
            width = length * sum(n for a, b, n in rows if (a, b) == (label, p)) / most
            marks.append(f'<rect x="{x:g}" y="{y}" width="{width:g}" height="15" fill="{COLOURS[c % len(COLOURS)]}"/>')
            x += width
    return _svg(title, LEFT + max(length, 90 * len(parts)) + 60, TOP + 20 * len(labels) + 20, marks)


def _grid(df: DataFrame, title: str, mark) -> str:
    """Rows (row, column, n, ...) on a grid of sorted labels; ``mark`` draws a cell from x, y and the rest of its row."""
    rows = _collected(df)
    ys, xs = sorted({r[0] for r in rows}, key=str), sorted({r[1] for r in rows}, key=str)
    marks = [_text(LEFT - 6, TOP + 40 + CELL * (k + 0.6), y) for k, y in enumerate(ys)]
    marks += [_text(LEFT + CELL * (k + 0.5), TOP + 34, x, "start", f' transform="rotate(-40 {LEFT + CELL * (k + 0.5):g} {TOP + 34})"') for k, x in enumerate(xs)]
    marks += [mark(LEFT + CELL * (xs.index(r[1]) + 0.5), TOP + 40 + CELL * (ys.index(r[0]) + 0.5), r[2:]) for r in rows]
    return _svg(title, LEFT + CELL * len(xs) + 80, TOP + 60 + CELL * len(ys), marks)


def heatmap(df: DataFrame, title: str) -> str:
    """Rows (row, column, n) or (row, column, n, is_gap): darker for more, gaps with a red frame, the number in each cell."""
    most = max([r[2] for r in _collected(df)] or [1]) or 1

    def cell(x: float, y: float, rest: tuple) -> str:
        shade = round(255 - 170 * rest[0] / most)
        frame = ' stroke="#c4504d" stroke-width="2"' if len(rest) > 1 and rest[1] else ' stroke="#dddddd"'
        return f'<rect x="{x - CELL / 2 + 1:g}" y="{y - CELL / 2 + 1:g}" width="{CELL - 2}" height="{CELL - 2}" fill="rgb({shade},{shade},255)"{frame}/>' + _text(x, y + 4, rest[0], "middle")

    return _grid(df, title, cell)


def bubbles(df: DataFrame, title: str) -> str:
    """Rows (row, column, n): an area of 20 + 30 n, cut to its cell, and the number; nothing for 0."""

    def bubble(x: float, y: float, rest: tuple) -> str:
        radius = min(CELL / 2, ((20 + 30 * rest[0]) / 3.14159) ** 0.5)
        return f'<circle cx="{x:g}" cy="{y:g}" r="{radius:.2f}" fill="{COLOURS[0]}" fill-opacity="0.6"/>' + _text(x, y + 4, rest[0], "middle") if rest[0] else ""

    return _grid(df, title, bubble)
