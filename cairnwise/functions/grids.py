"""Fixed grids: the 366 calendar days and the 9 x 9 difficulty/terrain cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DAYS_PER_MONTH = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
LEAP_DAY = "02-29"
GRID_STEPS = [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0]
GRID_CELLS = 81


def calendar_days() -> Column:
    """Array literal of every 'MM-dd', 29 February included."""
    days = [f"{m:02d}-{d:02d}" for m, n in enumerate(DAYS_PER_MONTH, start=1) for d in range(1, n + 1)]
    return F.split(F.lit(",".join(days)), ",")


def half_step(value: Column) -> Column:
    """Nearest multiple of 0.5, ties to even."""
    return F.bround(value * 2) / 2


def on_grid(value: Column) -> Column:
    return value.between(1.0, 5.0)


def grid_label(difficulty: Column, terrain: Column) -> Column:
    """'1.5/3.0' style label; sorts like the pair of numbers."""
    return F.concat_ws("/", F.format_number(difficulty, 1), F.format_number(terrain, 1))


def grid_labels() -> Column:
    return F.split(F.lit(",".join(f"{d:.1f}/{t:.1f}" for d in GRID_STEPS for t in GRID_STEPS)), ",")


# The 81 cells as bits of two longs (63 + 18), so that sets of cells combine
# with bit_or in a plain hash aggregate.
_LOW_BITS = 63


def cell_index(difficulty: Column, terrain: Column) -> Column:
    """0..80 for a cell on the grid (read to one decimal), else null."""
    d, t = F.round(difficulty, 1) * 2 - 2, F.round(terrain, 1) * 2 - 2
    valid = d.between(0, 8) & t.between(0, 8) & (d % 1 == 0) & (t % 1 == 0)
    return F.when(valid, (d * 9 + t).cast("int"))


def cell_bits(index: Column) -> tuple[Column, Column]:
    one = F.lit(1).cast("long")
    low = F.when(index < _LOW_BITS, F.call_function("shiftleft", one, index))
    high = F.when(index >= _LOW_BITS, F.call_function("shiftleft", one, index - _LOW_BITS))
    return low, high


def cells_within(low: Column, high: Column, max_d: Column, max_t: Column, present: bool = True) -> Column:
    """Indexes of the cells up to the bounds that are set (or not set)."""
    steps = F.sequence(F.lit(0), F.lit(GRID_CELLS - 1))
    zero = F.lit(0).cast("long")
    low, high = F.coalesce(low, zero), F.coalesce(high, zero)

    def keep(i: Column) -> Column:
        bit = F.when(i < _LOW_BITS, F.call_function("getbit", low, F.least(i, F.lit(_LOW_BITS - 1)))).otherwise(
            F.call_function("getbit", high, F.greatest(i - _LOW_BITS, F.lit(0)))
        )
        d, t = 1 + F.floor(i / 9) * 0.5, 1 + (i % 9) * 0.5
        return (d <= max_d) & (t <= max_t) & (bit == (1 if present else 0))

    return F.filter(steps, keep)
