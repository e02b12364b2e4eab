"""Column expressions over boxes (x, y, w, h). Boxes are half-open; touching boxes share nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def area(w, h) -> Column:
    return _c(w) * _c(h)


def intersection(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    ax, ay, aw, ah, bx, by, bw, bh = map(_c, (ax, ay, aw, ah, bx, by, bw, bh))
    zero = F.lit(0)
    return F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx)) * F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))


def page_pairs(boxes, others=None, keys=("page_id",)):
    """Pairs of boxes that overlap on one page: a_* and b_* columns, and inter. Pages are dealt by key; only overlapping pairs are kept."""
    cols = [c for c in boxes.columns if c not in keys]
    a = boxes.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    other = boxes if others is None else others
    b = other.select(*keys, *[F.col(c).alias(f"b_{c}") for c in other.columns if c not in keys])
    out = a.join(b, list(keys)).withColumn("inter", intersection(*[f"{s}_{c}" for s in "ab" for c in ("x", "y", "w", "h")]))
    out = out.where("inter > 0")
    return out.where("a_box_id <> b_box_id") if others is None else out
