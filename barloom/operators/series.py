"""Row-order operators that never put a whole series into one task.

A series (all rows of one key) may be a third of the data. Everything that depends on row order
is therefore cut into blocks:

* `dense_position` numbers the rows of each key with one small prefix sum over segment sizes;
* `by_blocks` runs bounded window frames on (key, block) groups that also hold a copy of the few
  rows before and after the block, so frames see across the cut;
* `carry_forward` and `running_sum` do unbounded frames as "inside the block" plus one carry row
  per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barloom.session import stage

BLOCK_ROWS = 32_768
KEY_ROWS = 50_000  # rows of a per-key table that may be broadcast
SALTS = 64  # copies of a longer one
RANGE_ROWS = 500_000  # rows of one range of an ordered table

TIMEFRAME_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14_400, "1d": 86_400, "1w": 604_800}


def time_segment(seconds: int, ts: str | Column = "ts") -> Column:
    """Segment number of a timestamp; bars are unique per time step, so a segment is bounded."""
    return F.floor(F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts) / F.lit(seconds))


def before(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """All earlier rows of the (small) per-block table."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def carried(blocks: DataFrame) -> DataFrame:
    """The per-block side of a join back to the rows.

    Hashed per partition, never broadcast: it grows with the data, and size estimates of the row
    side are too low where rules are exploded.
    """
    return blocks.hint("shuffle_hash")


def look_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], salt: Column, how: str = "inner", most: int = KEY_ROWS) -> DataFrame:
    """Join `rows` with a table of few rows per key, without gathering the rows of a key in one task.

    The table is written and counted. Up to `most` rows of it are broadcast; a longer one is copied once
    per salt, and the rows of a key are dealt over the copies by `salt`, any value that differs between
    them.
    """
    table = stage(table, "key-table")
    if table.count() <= most:
        return rows.join(F.broadcast(table), list(keys), how)
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("long"))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def dense_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, name: str = "pos"
) -> DataFrame:
    """Add the 0-based row number of each row within its key.

    `segment` must be monotone in `order` and hold a bounded number of rows.
    """
    keys = list(keys)
    cut = df.withColumn("_seg", segment)
    sizes = cut.groupBy(*keys, "_seg").agg(F.count("*").alias("_n"))
    bases = sizes.select(*keys, "_seg", F.coalesce(F.sum("_n").over(before(keys, ["_seg"])), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order))
    return (
        cut.withColumn("_rn", rank)
        .join(carried(bases), [*keys, "_seg"])
        .withColumn(name, F.col("_base") + F.col("_rn") - 1)
        .drop("_seg", "_rn", "_base")
    )


def number_bars(df: DataFrame, keys: Sequence[str] = ("symbol",), step: str = "1h", rows: int = BLOCK_ROWS) -> DataFrame:
    """`dense_position` for bars that are unique per time step."""
    return dense_position(df, keys, ["ts"], time_segment(TIMEFRAME_SECONDS[step] * rows))


def spread_blocks(
    df: DataFrame, back: int = 0, ahead: int = 0, rows: int = BLOCK_ROWS, pos: str = "pos"
) -> DataFrame:
    """Copy each row to every block that needs it: its own, and neighbours within reach."""
    first = F.floor((F.col(pos) - F.lit(ahead)) / rows)
    last = F.floor((F.col(pos) + F.lit(back)) / rows)
    return df.withColumn("_blk", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("long"), last.cast("long"))))


def own_rows(df: DataFrame, rows: int = BLOCK_ROWS, pos: str = "pos") -> DataFrame:
    """Drop the copies again."""
    return df.where(F.floor(F.col(pos) / rows) == F.col("_blk")).drop("_blk")


def by_blocks(
    df: DataFrame,
    keys: Sequence[str],
    fn: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int,
    ahead: int = 0,
    rows: int = BLOCK_ROWS,
    pos: str = "pos",
) -> DataFrame:
    """Run `fn(df, window)`; frames may reach `back` rows back and `ahead` rows forward in all."""
    spread = spread_blocks(df, back, ahead, rows, pos)
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    return own_rows(fn(spread, w), rows, pos)


def running_sum(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], sums: dict[str, Column], lagged: bool = False
) -> DataFrame:
    """Cumulative sums over each key; `lagged` leaves the current row out."""
    keys = list(keys)
    src = df.select("*", *[v.alias(f"_s_{k}") for k, v in sums.items()])
    totals = src.groupBy(*keys, block).agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    bases = totals.select(
        *keys, block, *[F.sum(f"_t_{k}").over(before(keys, [block])).alias(f"_b_{k}") for k in sums]
    )
    w = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if lagged else 0)
    zero = F.lit(0)
    inside = src.select("*", *[F.sum(f"_s_{k}").over(w).alias(f"_i_{k}") for k in sums])
    return inside.join(carried(bases), [*keys, block]).select(
        *[c for c in df.columns],
        *[(F.coalesce(F.col(f"_b_{k}"), zero) + F.coalesce(F.col(f"_i_{k}"), zero)).alias(k) for k in sums],
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], columns: Sequence[str], lagged: bool = False
) -> DataFrame:
    """Last non-NULL value at or before each row (strictly before when `lagged`), per column."""
    keys = list(keys)
    key_of_row = F.struct(*order)
    ends = df.groupBy(*keys, block).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), key_of_row)).alias(f"_e_{c}") for c in columns]
    )
    carries = ends.select(
        *keys, block, *[F.last(f"_e_{c}", ignorenulls=True).over(before(keys, [block])).alias(f"_c_{c}") for c in columns]
    )
    w = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if lagged else 0)
    keep = [c for c in df.columns if c not in columns]
    inside = df.select(*keep, *[F.last(c, ignorenulls=True).over(w).alias(f"_i_{c}") for c in columns])
    return inside.join(carried(carries), [*keys, block]).select(
        *keep, *[F.coalesce(f"_i_{c}", f"_c_{c}").alias(c) for c in columns]
    )


def carry_backward(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """First non-NULL value at or after each row."""
    keys = list(keys)
    key_of_row = F.struct(*order)
    starts = df.groupBy(*keys, block).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), key_of_row)).alias(f"_e_{c}") for c in columns]
    )
    later = Window.partitionBy(*keys).orderBy(block).rowsBetween(1, Window.unboundedFollowing)
    carries = starts.select(*keys, block, *[F.first(f"_e_{c}", ignorenulls=True).over(later).alias(f"_c_{c}") for c in columns])
    w = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    keep = [c for c in df.columns if c not in columns]
    inside = df.select(*keep, *[F.first(c, ignorenulls=True).over(w).alias(f"_i_{c}") for c in columns])
    return inside.join(carried(carries), [*keys, block]).select(
        *keep, *[F.coalesce(f"_i_{c}", f"_c_{c}").alias(c) for c in columns]
    )


def range_parts(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], rows: int = RANGE_ROWS, name: str = "_part") -> DataFrame:
    """`df` cut into ranges of about `rows` rows in the order (keys, order), with the range's number.

    The bounds follow the data, whatever its distribution, and rows of equal place stay together. The
    table is written: a row keeps its range however often it is read.
    """
    parts = max(1, -(-df.count() // rows))
    cut = df.repartitionByRange(parts, *keys, *order) if parts > 1 else df.coalesce(1)
    return stage(cut.withColumn(name, F.spark_partition_id()), "ranges")


def ordered_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column], lagged: bool = False, rows: int = RANGE_ROWS) -> DataFrame:
    """Running sums in any order, for keys of any size: sums inside ranges plus the totals of the ranges before."""
    return running_sum(range_parts(df, keys, order, rows), keys, "_part", order, sums, lagged).drop("_part")


def ordered_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Row number from 1 within each key; `order` must leave no ties."""
    return ordered_sums(df, keys, order, {name: F.lit(1).cast("long")}, rows=rows)
