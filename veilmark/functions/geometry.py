"""Rectangles and polygons as columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.numeric import round_up_half, whole

SIDES = ("x", "y", "w", "h")


def make_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for n, c in zip(SIDES, (x, y, w, h))])


def center(box: Column) -> tuple[Column, Column]:
    return box["x"] + box["w"] / 2, box["y"] + box["h"] / 2


def center_of(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x + w / 2, y + h / 2


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def scale_box(box: Column, fx: Column, fy: Column | None = None) -> Column:
    """Multiply the four numbers and truncate."""
    fy = fx if fy is None else fy
    return make_box(*(whole(box[n] * f) for n, f in zip(SIDES, (fx, fy, fx, fy))))


def shrink_box(box: Column, scale: Column) -> Column:
    """Divide the four numbers and truncate."""
    return make_box(*(whole(box[n] / scale) for n in SIDES))


def scale_polygon(polygon: Column, fx: Column, fy: Column) -> Column:
    return F.transform(polygon, lambda p: F.array(whole(p[0] * fx), whole(p[1] * fy)))


def polygon_box(polygon: Column, inclusive: bool = True) -> Column:
    """Smallest upright rectangle; `inclusive` counts the far pixel row and column."""
    xs = F.transform(polygon, lambda p: p[0])
    ys = F.transform(polygon, lambda p: p[1])
    extra = 1 if inclusive else 0
    return make_box(
        F.array_min(xs), F.array_min(ys),
        F.array_max(xs) - F.array_min(xs) + extra, F.array_max(ys) - F.array_min(ys) + extra,
    )


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def lerp_box(a: Column, b: Column, t: Column) -> Column:
    return make_box(*(whole(lerp(a[n], b[n], t)) for n in SIDES))


def lerp_polygon(a: Column, b: Column, t: Column) -> Column:
    """Vertex by vertex when the counts agree, else hold the earlier shape."""
    mixed = F.zip_with(
        a, b, lambda p, q: F.array(whole(lerp(p[0], q[0], t)), whole(lerp(p[1], q[1], t)))
    )
    return F.when(F.size(a) == F.size(b), mixed).otherwise(a)


def pad_box(box: Column, frame_w: Column, frame_h: Column, share: float) -> Column:
    """Renderer padding: truncated share on every side, clamped corners."""
    dx, dy = whole(box["w"] * share), whole(box["h"] * share)
    x, y = F.greatest(F.lit(0), box["x"] - dx), F.greatest(F.lit(0), box["y"] - dy)
    return make_box(
        x, y,
        F.least(frame_w, box["x"] + box["w"] + dx) - x,
        F.least(frame_h, box["y"] + box["h"] + dy) - y,
    )


def pad_overlay_box(box: Column, frame_w: Column, frame_h: Column, share: float) -> Column:
    """Overlay padding: rounded share, size limited by what is left of the frame."""
    dx, dy = round_up_half(box["w"] * share), round_up_half(box["h"] * share)
    x, y = F.greatest(F.lit(0), box["x"] - dx), F.greatest(F.lit(0), box["y"] - dy)
    return make_box(
        x, y,
        F.least(frame_w - x, box["w"] + dx * 2), F.least(frame_h - y, box["h"] + dy * 2),
    )


def box_union(a: Column, b: Column) -> Column:
    """Smallest rectangle around two."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return make_box(
        x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y
    )


def contains_point(box: Column, px: Column, py: Column) -> Column:
    return (
        (px >= box["x"]) & (px <= box["x"] + box["w"])
        & (py >= box["y"]) & (py <= box["y"] + box["h"])
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two rectangles."""
    across = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    down = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    shared = (across * down).cast("double")
    return shared / (a["w"] * a["h"] + b["w"] * b["h"] - shared)
