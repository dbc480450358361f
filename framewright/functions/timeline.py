"""Frame numbers, times and ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FPS = 25
BEGIN, END = "BEGIN", "END"


def time_to_frame(ms: Column, fps: float = FPS) -> Column:
    """Frame at a time, as double arithmetic on hours, minutes, seconds and milliseconds gives it (1160 ms: 28, not 29)."""
    whole = (F.floor(ms / 3_600_000) * 3600 + F.floor(ms % 3_600_000 / 60_000) * 60 + F.floor(ms % 60_000 / 1000)).cast("double")
    return ((whole + (ms % 1000) / F.lit(1000.0)) * F.lit(float(fps))).cast("bigint")


def frame_to_seconds(frame: Column, fps: float = FPS) -> Column:
    return frame / F.lit(float(fps))


def shift(ms: Column, minutes: int = 0, seconds: int = 0, milliseconds: int = 0) -> Column:
    return ms + F.lit(minutes * 60_000 + seconds * 1000 + milliseconds)


def rescale(ms: Column, ratio: float) -> Column:
    """Times multiplied by a ratio, to the nearest millisecond, halves to even."""
    return F.rint(ms * F.lit(float(ratio))).cast("bigint")


def frame_range(frame: Column, start: int | str = BEGIN, stop: int | str = END) -> Column:
    """Whether a frame lies in start..stop, both included."""
    low, high = _bounds(start, stop)
    return frame >= low if high is None else (frame >= low) & (frame <= high)


def frame_time(frame: Column, rate: Column) -> Column:
    """Time of a frame under a rate written num/den; null if the rate is not so written, or is zero."""
    num, den = (F.regexp_extract(rate, r"(\d+)/(\d+)", k) for k in (1, 2))
    ratio = F.try_divide(F.nullif(num, F.lit("")).cast("double"), F.nullif(den, F.lit("")).cast("double"))
    return F.try_divide(frame.cast("double"), ratio)


def _bounds(start: int | str, stop: int | str) -> tuple[int, int | None]:
    def number(x: int | str) -> int:
        if isinstance(x, bool) or not re.fullmatch(r"\d+", str(x)):
            raise ValueError(f"not a frame number: {x!r}")
        return int(x)

    return 0 if start == BEGIN else number(start), None if stop == END else number(stop)


def select_expression(start: int | str = BEGIN, stop: int | str = END) -> str:
    """The frame range as a video filter's select expression."""
    low, high = _bounds(start, stop)
    return rf"gte(n\,{low})" + ("" if high is None else rf"*lte(n\,{high})")


def time_expression(start: int | str = BEGIN, stop: int | str = END, rate: tuple[int, int] = (FPS, 1)) -> str:
    """The same range in time, as an audio filter's select expression."""
    low, high = _bounds(start, stop)

    def at(n: int) -> str:
        return repr(n / (rate[0] / rate[1])) if n else "0"

    return rf"gte(t\,{at(low)})" + ("" if high is None else rf"*lte(t\,{at(high)})")
