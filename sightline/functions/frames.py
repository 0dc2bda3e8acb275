"""Numbers of frames and clusters, and frame indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frames_by_duration(seconds: Column) -> Column:
    """Four frames for every four seconds begun and done, from 128 to 512."""
    return F.least(F.lit(512), F.greatest(F.lit(128), 4 * F.floor(seconds / 4))).cast("int")


def adaptive_fps(total: Column, fps: Column, most: int = 1024, margin: int = 32) -> Column:
    """Frames a second so that at most ``most - margin`` frames are taken, but 0.1 at least; all frames fit: at most 1."""
    rate = F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(1.0))
    target = F.greatest(F.lit(1), F.least(total, F.lit(most - margin)))
    return F.when(total <= target, F.least(F.lit(1.0), rate)).otherwise(F.greatest(F.lit(0.1), rate / (total / target)))


def centred_indices(start: Column, end: Column, fps: Column, last: Column, first: int = 0, segments: int = 32) -> Column:
    """An index near the middle of each of ``segments`` equal parts; rounded half to even."""
    a = F.greatest(F.lit(first), F.bround(start * fps).cast("int"))
    b = F.least(F.bround(end * fps).cast("int"), last)
    size = (b - a) / F.lit(float(segments))
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: (a + size / 2 + F.bround(size * i)).cast("int"))


def segment_frames(first: Column, end: Column, fps: Column, every: float = 1.5, filtered: bool = True) -> Column:
    """Frames to draw from a segment: one for every ``every`` seconds, one at least, twice as many if poor ones are dropped."""
    seconds = F.when(fps > 0, (end - first) / fps).otherwise(0.0)
    return (F.greatest(F.lit(1), F.floor(seconds / every)) * (2 if filtered else 1)).cast("int")


def clusters(n: Column, most: int) -> Column:
    """How many clusters ``n`` frames are put into: one for every eight, and one more, ``most`` at most."""
    return F.least(F.floor(n / 8) + 1, F.lit(most)).cast("int")
