"""Time windows and frame times over seconds, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window(start: Column, end: Column) -> Column:
    return F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"))


def latter(start: Column, end: Column, cap: float | None) -> Column:
    """The last ``cap`` seconds; no cap for None or 0."""
    return window(F.when(end - start > cap, end - cap).otherwise(start) if cap else start, end)


def earlier(start: Column, end: Column, cap: float | None) -> Column:
    """The first ``cap`` seconds; no cap for None or 0."""
    return window(start, F.when(end - start > cap, start + cap).otherwise(end) if cap else end)


def after(at: Column, clip_end: Column, seconds: float | None, least: float = 0.5) -> Column:
    """What follows ``at`` in the clip; an empty window is widened to half a second, but not beyond the clip."""
    end = F.least(clip_end, at + (seconds or 0.0))
    return window(at, F.when(end <= at, F.least(clip_end, at + least)).otherwise(end))


def observed(at: Column, clip_start: Column, seconds: float) -> Column:
    """The ``seconds`` up to ``at``, not before the clip."""
    return window(F.greatest(clip_start, at - seconds), at)


def anchor(clip_start: Column, duration: Column, ratio: Column) -> Column:
    return clip_start + duration * ratio


def clamp_time(x: Column, low: Column, high: Column, tolerance: float = 1e-3) -> Column:
    """The time inside its bounds, rounded to ms; null where it is outside by more than the tolerance."""
    ok = ~F.isnan(x) & (x >= low - tolerance) & (x <= high + tolerance)
    return F.when(ok, F.round(F.least(F.greatest(x, low), high), 3))


def uniform_times(start: Column, end: Column, n: int) -> Column:
    """``n`` times from start to end; one time is the end."""
    if n == 1:
        return F.array(end.cast("double"))
    step = (end - start) / F.lit(float(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i * step)


def tail_times(start: Column, end: Column, n: int) -> Column:
    """``n`` times over the last ``n`` seconds; an empty span is widened to half a second."""
    low = F.greatest(F.lit(0.0), start)
    low = F.when(end <= low, F.greatest(F.lit(0.0), end - 0.5)).otherwise(low)
    return uniform_times(F.greatest(low, end - F.lit(float(n))), end, n)


def policy_times(sample_type: Column, start: Column, end: Column, n: int) -> Column:
    """Whole-clip samples are looked at evenly, anchored ones at their tail."""
    return F.when(sample_type == "offline_answer", uniform_times(start, end, n)).otherwise(tail_times(start, end, n))


def frame_indices(n_frames: Column, n: int) -> Column:
    """Whole parts of ``n`` evenly spaced frame numbers."""
    return F.transform(uniform_times(F.lit(0.0), (n_frames - 1).cast("double"), n), lambda x: x.cast("long"))


def trimmed_indices(n_frames: Column, n: int, trim: float = 0.05) -> Column:
    """Evenly spaced frame numbers without the ends."""
    low, high = (n_frames * F.lit(trim)).cast("long"), (n_frames * F.lit(1 - trim)).cast("long")
    return F.transform(uniform_times(low.cast("double"), high.cast("double"), n), lambda x: x.cast("long"))


def preview_indices(n_frames: Column, n: int = 5) -> Column:
    """Evenly spaced frame numbers from 10 to 90 per cent."""
    total = n_frames.cast("double")
    return F.transform(uniform_times(total * 0.1, total * 0.9, n), lambda x: x.cast("long"))


def sample_positions(n_frames: Column) -> Column:
    """The frames at 10, 50 and 90 per cent, for looking at by hand."""
    return F.array(*[(n_frames * F.lit(p)).cast("long") for p in (0.1, 0.5, 0.9)])


def frames_at(times: Column, fps: Column, n_frames: Column) -> Column:
    """Numbers of the frames at ``times``, ties to even; inside the file where its length is known (above 0)."""
    inside = lambda i: F.when(n_frames > 0, F.least(F.greatest(i, F.lit(0).cast("long")), n_frames.cast("long") - 1)).otherwise(i)
    return F.transform(times, lambda t: inside(F.bround(t * fps, 0).cast("long")))
