"""Boxes in pixels, in shares and in thousandths of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _inside(c: Column, most: int = 1000) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), c))


def _widened(lo: Column, hi: Column, least: int, both: bool = True) -> tuple[Column, Column]:
    """A flat side is given ``least``, to the right where there is room, else (``both``) to the left."""
    far = F.when(hi <= lo, F.least(F.lit(1000), lo + least)).otherwise(hi)
    near = F.when((hi <= lo) & (far <= lo), F.greatest(F.lit(0), far - least)).otherwise(lo) if both else lo
    return near, far


def _box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(*[c.cast("int") for c in (x1, y1, x2, y2)])


def _scaled(box: Column, width: Column, height: Column, how) -> list[Column]:  # noqa: ANN001
    w, h = F.greatest(F.lit(1.0), width.cast("double")), F.greatest(F.lit(1.0), height.cast("double"))
    return [_inside(how(1000.0 * F.get(box, i) / (w if i % 2 == 0 else h)).cast("int")) for i in range(4)]


def to_thousandths(box: Column, width: Column, height: Column, least: int = 2) -> Column:
    """Pixels to 0..1000, cut off; no side is shorter than ``least`` if it was flat."""
    x1, y1, x2, y2 = _scaled(box, width, height, lambda c: c)
    (x1, x2), (y1, y2) = _widened(x1, x2, least), _widened(y1, y2, least)
    return F.when(F.size(box) == 4, _box(x1, y1, x2, y2))


def to_thousandths_rounded(box: Column, width: Column, height: Column) -> Column:
    """Pixels to 0..1000, rounded half to even; flat boxes stay flat."""
    return F.when(F.size(box) == 4, _box(*_scaled(box, width, height, lambda c: F.bround(c, 0))))


def auto_thousandths(box: Column, width: Column, height: Column) -> Column:
    """Shares, thousandths or pixels, told apart by their size, to 0..1000."""
    half = lambda c: F.bround(c, 0)
    shares = [half(F.get(box, i) * 1000) for i in range(4)]
    pixels, ready = _scaled(box, width, height, half), [_inside(half(F.get(box, i)).cast("int")) for i in range(4)]
    fixed = []
    for x1, y1, x2, y2 in (pixels, ready):
        fixed.append(_box(x1, y1, _widened(x1, x2, 2, both=False)[1], _widened(y1, y2, 2, both=False)[1]))
    return F.when(F.size(box) == 4, F.when(F.array_max(box) <= 1.0, _box(*shares)).when((F.get(box, 2) > 1000) | (F.get(box, 3) > 1000), fixed[0]).otherwise(fixed[1]))


def with_margin(box: Column, width: Column, height: Column, share: float = 0.05) -> Column:
    """A box wider by a share of its sides (whole pixels) on every side, within the page."""
    dx, dy = ((F.get(box, 2) - F.get(box, 0)) * share).cast("int"), ((F.get(box, 3) - F.get(box, 1)) * share).cast("int")
    return F.when(F.size(box) == 4, _box(F.greatest(F.lit(0), F.get(box, 0) - dx), F.greatest(F.lit(0), F.get(box, 1) - dy), F.least(width, F.get(box, 2) + dx), F.least(height, F.get(box, 3) + dy)))


def sound(box: Column) -> Column:
    """Four numbers with 0 <= x1 < x2 <= 1000 and the same for y."""
    return F.coalesce((F.size(box) == 4) & (F.get(box, 0) >= 0) & (F.get(box, 1) >= 0) & (F.get(box, 0) < F.get(box, 2)) & (F.get(box, 1) < F.get(box, 3)) & (F.get(box, 2) <= 1000) & (F.get(box, 3) <= 1000), F.lit(False))
