"""Functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(v: Column) -> Column:
    shifted = F.transform(v, lambda x: F.exp(x.cast("double") - F.array_max(v).cast("double")))
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def argmax(v: Column) -> Column:
    """Place of the greatest value, the first of equal ones, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def within(a: Column, b: Column, atol: float = 1e-5, rtol: float = 1e-4) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def boosted(confidence: Column, agent: Column, validated: Column) -> Column:
    """Up by .15 for an agent and by .10 for validation, each capped at .95."""
    c = F.when(agent, F.least(confidence + 0.15, F.lit(0.95))).otherwise(confidence)
    return F.when(validated, F.least(c + 0.10, F.lit(0.95))).otherwise(c)


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(0.5 * (1 + F.cos(F.pi() * progress)))


def padded_box(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column, pad: float = 0.05) -> list[Column]:
    """Left, top, right and bottom pixels of a normalised box with padding, truncated and clamped."""
    x1, y1 = (cx - w / 2) * width, (cy - h / 2) * height
    x2, y2 = (cx + w / 2) * width, (cy + h / 2) * height
    px, py = (x2 - x1) * pad, (y2 - y1) * pad
    low = lambda v: F.greatest(F.lit(0), v.cast("int"))
    return [low(x1 - px), low(y1 - py), F.least(width.cast("int"), (x2 + px).cast("int")), F.least(height.cast("int"), (y2 + py).cast("int"))]
