"""Number helpers with the rounding the data model expects."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.schemas import DEFAULT_FPS


def whole(value: Column, kind: str = "int") -> Column:
    """Truncate toward zero."""
    return value.cast(kind)


def round_even(value: Column, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(value, digits)


def round_up_half(value: Column) -> Column:
    """Round half toward positive infinity, as an integer."""
    return F.floor(value + F.lit(0.5)).cast("int")


def clamp(value: Column, low, high) -> Column:
    """Keep a value within [low, high]; low wins when the limits cross."""
    lo = low if isinstance(low, Column) else F.lit(low)
    return F.greatest(lo, F.least(value, high if isinstance(high, Column) else F.lit(high)))


def usable_fps(fps: Column) -> Column:
    """A missing or non-positive rate becomes the default rate."""
    rate = fps.cast("double")
    return F.when(rate > 0, rate).otherwise(F.lit(DEFAULT_FPS))


def frame_to_ms(frame: Column, fps: Column, kind: str = "int") -> Column:
    return whole((frame / fps) * F.lit(1000), kind)


def ms_to_frame(ms: Column, fps: Column, kind: str = "int") -> Column:
    return whole((ms / F.lit(1000)) * fps, kind)


def rational(text: Column) -> Column:
    """`a/b` as a double."""
    parts = F.split(text, "/")
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
