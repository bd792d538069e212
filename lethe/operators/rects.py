"""Rectangles that cover a span of characters on a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def span_rects(boxes: Column, s: Column, e: Column, pad_x: float = 0.0, pad_y: float = 0.5) -> Column:
    """array of boxes for characters s (included) to e (not): one for each line, null boxes skipped, padded on all sides."""
    own = F.filter(F.slice(boxes, s + 1, e - s), lambda b: b.isNotNull())
    start = F.struct(F.lit(None).cast(_BOX).alias("cur"), F.array().cast(f"array<{_BOX}>").alias("out"))
    box = lambda *v: F.struct(*(x.alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)))

    def step(a, b):
        c = a["cur"]
        height = F.greatest(c["y1"] - c["y0"], b["y1"] - b["y0"], F.lit(1.0))
        apart = F.abs((c["y0"] + c["y1"]) / 2 - (b["y0"] + b["y1"]) / 2)
        same = c.isNotNull() & (apart < height * 0.5) & (b["x0"] >= c["x0"] - height)
        union = box(F.least(c["x0"], b["x0"]), F.least(c["y0"], b["y0"]), F.greatest(c["x1"], b["x1"]), F.greatest(c["y1"], b["y1"]))
        out = F.when(c.isNull() | same, a["out"]).otherwise(F.concat(a["out"], F.array(c)))
        return F.struct(F.when(same, union).otherwise(b).alias("cur"), out.alias("out"))

    lines = F.aggregate(own, start, step, lambda a: F.when(a["cur"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))
    return F.transform(lines, lambda r: box(r["x0"] - pad_x, r["y0"] - pad_y, r["x1"] + pad_x, r["y1"] + pad_y))


def pixel_rects(rects: Column, pad: int = 2) -> Column:
    """Whole-pixel rectangles to paint: padded, clamped at 0, rounded outwards."""
    low = lambda x: F.greatest(F.floor(x - pad), F.lit(0)).cast("int")
    return F.transform(rects, lambda r: F.struct(low(r["x0"]).alias("x0"), low(r["y0"]).alias("y0"), F.ceil(r["x1"] + pad).cast("int").alias("x1"), F.ceil(r["y1"] + pad).cast("int").alias("y1")))
