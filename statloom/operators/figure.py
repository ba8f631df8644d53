"""A picture of a column's distribution: histogram with normal curve, Q-Q plot and box plot, written as SVG or PDF.

All that's drawn comes from bounded frames (bins, curve points, picked order statistics, box, marks), which Spark computes.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterable
from typing import NamedTuple
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from . import shape

INCH = 72.0  # points
BAR, CURVE, DOT, BOX, MEDIAN, GRID, INK = "#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#ffff00", "#dddddd", "#000000"
Point = tuple[float, float]


class Mark(NamedTuple):
    """A path (filled if fill is set), circles of a radius at its points, or a text at its first point. Points count from the lower left, in points."""

    points: list[Point]
    line: str | None = None
    fill: str | None = None
    width: float = 1.0
    dashed: bool = False
    radius: float = 0.0
    text: str = ""
    size: float = 9.0
    turned: bool = False


def ticks(low: float, high: float, most: int = 6) -> list[float]:
    """At most about `most` round numbers from low to high."""
    if not high > low:
        return [low]
    step = 10 ** math.floor(math.log10((high - low) / most))
    step *= next(k for k in (1, 2, 5, 10) if (high - low) / (step * k) <= most)
    return [k * step for k in range(math.ceil(low / step), math.floor(high / step) + 1)]


class Panel:
    """A rectangle of the page with axes."""

    def __init__(self, x: float, y: float, width: float, height: float, xs: tuple[float, float], ys: tuple[float, float]):
        pad = lambda lo, hi: (lo - 0.04 * ((hi - lo) or 1), hi + 0.04 * ((hi - lo) or 1))
        self.at, self.size, self.xs, self.ys = (x, y), (width, height), pad(*xs), pad(*ys)

    def place(self, x: float, y: float) -> Point:
        part = lambda v, ends: (v - ends[0]) / (ends[1] - ends[0])
        return self.at[0] + part(x, self.xs) * self.size[0], self.at[1] + part(y, self.ys) * self.size[1]

    def axes(self, title: str, across: str, up: str, numbers: bool = True) -> Iterable[Mark]:
        (x, y), (w, h) = self.at, self.size
        for v in ticks(*self.ys):
            _, at = self.place(self.xs[0], v)
            yield Mark([(x, at), (x + w, at)], GRID, width=0.5)
            yield Mark([(x - 16, at - 3)], text=f"{v:.6g}", size=7)
        for v in ticks(*self.xs) if numbers else ():
            at, _ = self.place(v, self.ys[0])
            yield Mark([(at, y), (at, y + h)], GRID, width=0.5)
            yield Mark([(at, y - 11)], text=f"{v:.6g}", size=7)
        yield Mark([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], INK, width=0.8)
        yield Mark([(x + w / 2, y + h + 8)], text=title, size=11)
        yield Mark([(x + w / 2, y - 25)], text=across)
        yield Mark([(x - 36, y + h / 2)], text=up, turned=True)


def page(df: DataFrame, column: str, title: str, width: float, height: float, points: int = 256) -> list[Mark]:
    """The marks of a page of width by height inches; a column without finite values gives empty axes."""
    df = df.where(f"abs(`{column}`) < double('inf')").select(column)
    bars, curve = shape.histogram(df, column).collect(), shape.normal_curve(df, column).orderBy("i").collect()  # 30 and 100 rows
    qq = shape.qq_picked(df, column, points).orderBy("i").collect()  # `points` rows
    box, far = shape.box_statistics(df, column).first(), [r["v"] for r in shape.marks(df, column).collect()]  # one, and one a step
    w, h, out = width * INCH, height * INCH, []
    spare, left, low = (w - 60 - 3 * 55) / 3, 60.0, 50.0
    high = h - low - 70
    spots = [left + k * (spare + 55) for k in range(3)]
    known = bool(qq)
    ends = (bars[0]["left"], bars[-1]["right"]) if known else (0.0, 1.0)
    top = max([r["density"] for r in (*bars, *curve)] if known else [1.0])
    one = Panel(spots[0], low, spare, high, ends, (0.0, top))
    out += one.axes("Histogram and normal curve", "Value", "Density")
    for r in bars if known else ():
        (x0, y0), (x1, y1) = one.place(r["left"], 0), one.place(r["right"], r["density"])
        out.append(Mark([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], INK, BAR, 0.5))
    out.append(Mark([one.place(r["x"], r["density"]) for r in curve], CURVE, width=2, dashed=True))
    theory, sample = [r["theoretical"] for r in qq] or [0.0, 1.0], [r["sample"] for r in qq] or [0.0, 1.0]
    two = Panel(spots[1], low, spare, high, (theory[0], theory[-1]), (sample[0], sample[-1]))
    out += two.axes("Q-Q plot", "Theoretical quantiles", "Sample quantiles")
    if known:
        out.append(Mark([two.place(*p) for p in zip(theory, sample, strict=True)], fill=DOT, radius=2))
        out.append(Mark([two.place(theory[0], sample[0]), two.place(theory[-1], sample[-1])], CURVE, width=2))
    three = Panel(spots[2], low, spare, high, (0.0, 1.0), (sample[0], sample[-1]))
    out += three.axes("Box plot", "", "Value", numbers=False)
    if known and box:
        line = lambda *ps, **k: out.append(Mark([three.place(*p) for p in ps], INK, **k))
        a, b = box["q1"], box["q3"]
        line((0.3, a), (0.7, a), (0.7, b), (0.3, b), (0.3, a), fill=BOX)
        out.append(Mark([three.place(0.3, box["median"]), three.place(0.7, box["median"])], MEDIAN, width=1.5))
        for end, side in ((box["whisker_low"], a), (box["whisker_high"], b)):
            line((0.5, side), (0.5, end))
            line((0.4, end), (0.6, end))
        out.append(Mark([three.place(0.5, v) for v in far], fill=INK, radius=2))
    out.append(Mark([(w / 2, h - 22)], text=title, size=14))
    return [m for m in out if m.points]


def svg(marks: Iterable[Mark], width: float, height: float) -> bytes:
    w, h, out = width * INCH, height * INCH, []
    for m in marks:
        x, y = m.points[0][0], h - m.points[0][1]
        if m.text:
            turn = f' transform="rotate(-90 {x:.2f} {y:.2f})"' if m.turned else ""
            out.append(f'<text x="{x:.2f}" y="{y:.2f}" font-size="{m.size}" text-anchor="middle"{turn}>{escape(m.text)}</text>')
        elif m.radius:
            out += [f'<circle cx="{a:.2f}" cy="{h - b:.2f}" r="{m.radius}" fill="{m.fill}"/>' for a, b in m.points]
        else:
            path = " ".join(f"{a:.2f},{h - b:.2f}" for a, b in m.points)
            dash = ' stroke-dasharray="6 3"' if m.dashed else ""
            out.append(f'<polyline points="{path}" fill="{m.fill or "none"}" stroke="{m.line or "none"}" stroke-width="{m.width}"{dash}/>')
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{w:g}pt" height="{h:g}pt" viewBox="0 0 {w:g} {h:g}" font-family="Helvetica, sans-serif">'
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', head, f'<rect width="{w:g}" height="{h:g}" fill="white"/>', *out, "</svg>\n"]).encode()


def pdf(marks: Iterable[Mark], width: float, height: float) -> bytes:
    """One page. Texts are in Latin-1; other characters become question marks."""
    rgb = lambda c: " ".join(f"{int(c[k : k + 2], 16) / 255:.3f}" for k in (1, 3, 5))
    ops = []
    for m in marks:
        x, y = m.points[0]
        if m.text:
            half, text = m.size * 0.25 * len(m.text), m.text.encode("latin-1", "replace").decode("latin-1")
            for c in "\\()":
                text = text.replace(c, f"\\{c}")
            where = f"0 1 -1 0 {x:.2f} {y - half:.2f}" if m.turned else f"1 0 0 1 {x - half:.2f} {y:.2f}"
            ops.append(f"BT /F {m.size} Tf 0 g {where} Tm ({text}) Tj ET")
        elif m.radius:
            r, k = m.radius, 0.5523 * m.radius  # a circle of four curves
            ops.append(f"{rgb(m.fill)} rg")
            for a, b in m.points:
                curve = lambda *v: " ".join(f"{x:.2f}" for x in v) + " c"
                ops.append(f"{a + r:.2f} {b:.2f} m {curve(a + r, b + k, a + k, b + r, a, b + r)} {curve(a - k, b + r, a - r, b + k, a - r, b)} "
                           f"{curve(a - r, b - k, a - k, b - r, a, b - r)} {curve(a + k, b - r, a + r, b - k, a + r, b)} f")
        else:
            path = " ".join(f"{a:.2f} {b:.2f} {'l' if i else 'm'}" for i, (a, b) in enumerate(m.points))
            paint = "B" if m.line and m.fill else "f" if m.fill else "S"
            colours = (f"{rgb(m.line)} RG " if m.line else "") + (f"{rgb(m.fill)} rg " if m.fill else "")
            ops.append(f"{colours}{m.width} w [{'6 3' if m.dashed else ''}] 0 d {path} {paint}")
    body = zlib.compress("\n".join(ops).encode("latin-1"))
    box = f"[0 0 {width * INCH:g} {height * INCH:g}]"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox {box} /Contents 4 0 R /Resources << /Font << /F 5 0 R >> >> >>".encode(),
        f"<< /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    ]
    out, places = b"%PDF-1.4\n", []
    for k, content in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n".encode() + content + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


WRITERS = {"svg": svg, "pdf": pdf}
#: Endings that are taken for a picture's format; any other path gets the format's ending.
ENDINGS = ("png", "jpg", "jpeg", "pdf", "svg", "tiff")


def draw(df: DataFrame, column: str, path: str, title: str = "", width: float = 12, height: float = 10, kind: str = "pdf") -> str:
    """Writes the picture to a local file, in inches; returns its path, with the format's ending if it had none. Only SVG and PDF can be written; others raise ValueError."""
    ending = os.path.splitext(path)[1].lower().removeprefix(".")
    if ending not in ENDINGS:
        path, ending = f"{path}.{kind.lower()}", kind.lower()
    if ending not in WRITERS:
        raise ValueError(f"pictures are written as {' or '.join(WRITERS)}, not as {ending}")
    if folder := os.path.dirname(path):
        os.makedirs(folder, exist_ok=True)
    data = WRITERS[ending](page(df, column, title, width, height), width, height)
    with open(path, "wb") as f:
        f.write(data)
    return path
