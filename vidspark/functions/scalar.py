"""Column expressions: keys, hashes, cadence, geometry of rectangles and quadrilaterals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour cycle of detections, as (b, g, r).
LOGO_COLORS = [
    (255, 0, 255),
    (0, 255, 255),
    (255, 255, 0),
    (255, 0, 0),
    (0, 255, 0),
    (0, 0, 255),
    (0, 0, 0),
]
# Action names in class order.
ACTIONS = ["boxing", "handclapping", "handwaving", "jogging", "running", "walking"]


def div(a, b) -> Column:
    """Integer division truncating toward zero."""
    a = a if isinstance(a, Column) else F.col(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, b).cast("int")


def is_due(frame: str | Column, every: int, offset: int = 0) -> Column:
    """Cadence test ``(frame - offset) % every = 0``."""
    c = F.col(frame) if isinstance(frame, str) else frame
    return (c - F.lit(offset)) % every == 0


def patch_key(frame: Column, rect: Column) -> Column:
    """``N%04d@x0@y0@x1@y1``; ``@null`` for a template without a region."""
    x, y, w, h = (rect.getField(k) for k in "xywh")
    box = F.format_string("@%d@%d@%d@%d", x, y, x + w, y + h)
    return F.concat(F.format_string("N%04d", frame), F.when(rect.isNull(), "@null").otherwise(box))


def string_hash(c: Column) -> Column:
    """32-bit polynomial hash of base 31 (ASCII ids), wrapped to a signed int."""
    two32, half = F.lit(1 << 32), F.lit(1 << 31)
    codes = F.transform(F.split(c, ""), lambda s: F.ascii(s).cast("long"))
    return F.aggregate(
        codes,
        F.lit(0).cast("long"),
        lambda acc, x: F.pmod(acc * 31 + x + half, two32) - half,
    )


def route(c: Column, n: int) -> Column:
    return (F.abs(string_hash(c)) % n).cast("int")


def keep_trace(c: Column, rate: int) -> Column:
    """Thinning rule: drops the ids whose hash is a multiple of ``rate``."""
    return F.lit(True) if rate == 1 else route(c, rate) > 0


def bind(fields: dict[str, Column], fn) -> Column:
    """``fn`` of a struct that is computed once, however often its fields are used."""
    one = F.array(F.struct(*[c.alias(k) for k, c in fields.items()]))
    return F.get(F.transform(one, fn), F.lit(0))


def quad_box(q: list[tuple[Column, Column]]) -> tuple[Column, Column, Column, Column]:
    """Bounding box of four corners; the upper ends never fall below zero."""
    xs, ys = [p[0] for p in q], [p[1] for p in q]
    zero = F.lit(0.0)
    return F.least(*xs), F.greatest(zero, *xs), F.least(*ys), F.greatest(zero, *ys)


def quad_valid(
    q: list[tuple[Column, Column]],
    roi_w: Column,
    roi_h: Column,
    squeeze: bool = False,
    eps: float = 1e-2,
    box: tuple | None = None,
) -> Column:
    """Accept a projected template outline.

    Rejects boxes under 10 px, boxes over twice the region, outlines whose
    shoelace sum is under half the box, and outlines with a left turn.
    ``squeeze`` adds the side-ratio test, which is off by default.
    """
    x0, x1, y0, y1 = box or quad_box(q)
    w, h = x1 - x0, y1 - y0
    nxt = [q[(i + 1) % 4] for i in range(4)]
    shoelace = reduce(lambda a, b: a + b, [p[0] * n[1] - n[0] * p[1] for p, n in zip(q, nxt)])
    ok = (w >= 10) & (h >= 10) & (w <= 2 * roi_w) & (h <= 2 * roi_h)
    ok = ok & (F.abs(shoelace) >= F.lit(0.5) * w * h)
    for i in range(4):
        a, b, c = q[i - 1], q[i], nxt[i]
        turn = (a[0] - b[0]) * (c[1] - b[1]) - (c[0] - b[0]) * (a[1] - b[1])
        ok = ok & (turn <= eps)
    if squeeze:
        side = [(p[0] - n[0]) ** 2 + (p[1] - n[1]) ** 2 for p, n in zip(q, nxt)]
        for i in (0, 1):
            r = F.try_divide(side[i], side[i + 2])
            ok = ok & F.coalesce((r <= 3.0) & (r >= 1.0 / 3), F.lit(False))
    return ok


def project_point(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Perspective map of one point by nine matrix entries."""
    d = h[6] * x + h[7] * y + h[8]
    num_x = h[0] * x + h[1] * y + h[2]
    num_y = h[3] * x + h[4] * y + h[5]
    return F.try_divide(num_x, d), F.try_divide(num_y, d)


def padded_corners(rect: Column, tw: Column, th: Column) -> list[tuple[Column, Column]]:
    """Corners of ``rect`` grown by a tenth of the template and clamped to it."""
    x, y, w, h = (rect.getField(k).cast("double") for k in "xywh")
    x0 = F.greatest(x - tw / 10.0, F.lit(0.0))
    x1 = F.least(x + w + tw / 10.0, (tw - 1).cast("double"))
    y0 = F.greatest(y - th / 10.0, F.lit(0.0))
    y1 = F.least(y + h + th / 10.0, (th - 1).cast("double"))
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def project_corners(h: list[Column], rect: Column, tw: Column, th: Column):
    return [project_point(h, x, y) for x, y in padded_corners(rect, tw, th)]


def found_rect(q, pw: Column, ph: Column, roi_x: Column, roi_y: Column, box=None) -> Column:
    """Clamp the outline's box to the patch, truncate, shift to frame coordinates."""
    # Degenerate maps throw corners further out than an int reaches.
    x0, x1, y0, y1 = (F.least(F.greatest(c, F.lit(-1e9)), F.lit(1e9)).cast("int") for c in box or quad_box(q))
    x0, y0 = F.greatest(F.lit(0), x0), F.greatest(F.lit(0), y0)
    x1, y1 = F.least(pw.cast("int"), x1), F.least(ph.cast("int"), y1)
    return F.struct(
        (x0 + roi_x).cast("int").alias("x"),
        (y0 + roi_y).cast("int").alias("y"),
        (x1 - x0).cast("int").alias("w"),
        (y1 - y0).cast("int").alias("h"),
    )


def class_from_name(path: Column, names: list[str] = ACTIONS) -> Column:
    """Index of the first action name contained in a path, else -1."""
    hits = [F.when(path.contains(n), i) for i, n in enumerate(names)]
    return F.coalesce(*hits, F.lit(-1)).cast("int")


def action_name(cls: Column, names: list[str] = ACTIONS) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), cls), F.lit("unknown"))


def logo_color(logo: Column) -> Column:
    colors = [
        F.struct(F.lit(b).alias("b"), F.lit(g).alias("g"), F.lit(r).alias("r"))
        for b, g, r in LOGO_COLORS
    ]
    return F.get(F.array(*colors), (logo % len(LOGO_COLORS)).cast("int"))


def unit_slice(feat: Column, start: int, n: int) -> Column:
    """``n`` entries from 0-based ``start``, scaled to unit L2 length."""
    part = F.transform(F.slice(feat, start + 1, n), lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, v: a + v * v))
    # An expression inside a lambda would be worked out anew for every entry.
    return F.zip_with(part, F.array_repeat(norm, F.size(part)), F.try_divide)


def block_origin(p: Column, side: int, extent: Column) -> Column:
    """Start of a block of ``side`` centred on ``p``, kept inside ``[0, extent)``."""
    hi = (extent - side).cast("double")
    return F.least(F.greatest(p.cast("double") - side // 2, F.lit(0.0)), hi)
