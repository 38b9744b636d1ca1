"""Shape and schedule arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def conv_length(length: Column, layers: int, kernel: int, stride: int) -> Column:
    """Frames after ``layers`` strided convolutions with half-kernel padding."""
    step = lambda n, _: F.floor((n + 2 * (kernel // 2) - kernel) / stride + 1).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(layers)), length.cast("long"), step) if layers else length.cast("long")


def query_length(length: Column, window: int, queries: int) -> Column:
    """Vectors that a windowed query former gives."""
    return (F.ceil(length / window) * queries).cast("long")


def window_count(duration: Column, window: float) -> Column:
    """Encoder windows that a recording fills."""
    return F.ceil(duration / window).cast("long")


def prefix_mask(valid: Column, size: Column) -> Column:
    """``size`` booleans, the first ``valid`` true."""
    return F.when(size > 0, F.transform(F.sequence(F.lit(1).cast("long"), size.cast("long")), lambda i: i <= valid)).otherwise(F.array().cast("array<boolean>"))


def largest_batch(duration: Column, batch_duration: float, batch_size: int | None = None) -> Column:
    """Records of the longest duration that one batch holds, one at least."""
    n = F.greatest(F.lit(1), F.floor(F.lit(batch_duration) / duration))
    return (F.least(n, F.lit(batch_size)) if batch_size else n).cast("long")


def steps_per_epoch(cuts: Column, seconds: Column, *, batch_size: int | None = None, batch_duration: float | None = None, world: int = 1, accumulate: int = 1) -> Column:
    """Optimiser steps of one epoch; a batch size wins over a batch duration, -1 if neither is known."""
    if not batch_size and not batch_duration:
        return F.lit(-1).cast("long")
    batches = F.ceil(cuts / batch_size) if batch_size else F.ceil(seconds / batch_duration)
    steps = F.ceil(F.ceil(batches / world) / accumulate)
    return F.when(F.coalesce(cuts if batch_size else seconds, F.lit(0)) <= 0, 0).otherwise(steps).cast("long")
