"""Running sums in two levels, and the blocks of disks that files take.

Rows are dealt out by ranges of their keys and order, so that the rows of one key spread over as many ranges as they fill.
Sums of ranges are a few numbers a key; a row's running sum is that of the ranges before its own plus the one within it. No
task holds more than a range, however many rows a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import settle


def _same(left: str, right: str, keys: tuple[str, ...]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return same


def running_sum(rows: DataFrame, value: str, order: tuple[str, ...], keys: tuple[str, ...] = (), out: str = "upto", ranges: int | None = None) -> DataFrame:
    """rows with `out`: the sum of `value` over the rows of the same keys up to this one. `order` has to tell the rows of a key
    apart: of rows that it does not, each counts all of them or a part. Null keys are keys like others."""
    by = [F.col(c) for c in (*keys, *order)]
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    held = settle(dealt.withColumn("__range", F.spark_partition_id()))
    totals = held.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum"))
    ahead = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    inside = F.sum(value).over(Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    own = held.withColumn("__inside", inside).alias("own")
    told = own.join(before.alias("before"), (F.col("own.__range") == F.col("before.__range")) & _same("own", "before", keys))
    return told.select("own.*", F.col("before.__before")).withColumn(out, F.col("__before") + F.col("__inside")).drop("__before", "__inside", "__range")


def running_number(rows: DataFrame, order: tuple[str, ...], keys: tuple[str, ...] = (), out: str = "nth") -> DataFrame:
    """rows numbered from 1 in their order within their keys."""
    return running_sum(rows.withColumn("__one", F.lit(1).cast("long")), "__one", order, keys, out).drop("__one")


def first_seen(rows: DataFrame, value: Column, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value, first, slot): distinct values numbered from 0 by where each is first seen."""
    first = rows.groupBy(*keys, value.alias("value")).agg(F.min(order).alias("first"))
    return running_number(first, ("first", "value"), keys, "slot").withColumn("slot", F.col("slot") - 1)


def unique_names(rows: DataFrame, name: str, order: str, keys: tuple[str, ...] = (), separator: str = "_", keep: int | None = None) -> DataFrame:
    """`nth` and `unique`: the second and later rows of a name (in any case) get _2, _3 and so on.

    keep: the ProDOS form, in which the second row gets .1 and so on (with separator "."), after the first `keep` characters.
    """
    told = running_number(rows.withColumn("__folded", F.upper(name)), (order,), (*keys, "__folded")).drop("__folded")
    stem = F.col(name) if keep is None else F.substring(name, 1, keep)
    number = F.col("nth") if keep is None else F.col("nth") - 1
    return told.withColumn("unique", F.when(F.col("nth") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(separator), number)))


def allocate(files: DataFrame, size: str, unit: int, order: str, keys: tuple[str, ...] = ("disk_id",), first: int = 0) -> DataFrame:
    """Files one after the other: blocks, first block, end block (exclusive)."""
    told = running_sum(files.withColumn("blocks", F.expr(f"({size} + {unit - 1}) div {unit}")), "blocks", (order,), keys, "end_block")
    return told.withColumn("end_block", F.col("end_block") + first).withColumn("first_block", F.col("end_block") - F.col("blocks"))


def place(number: Column, first: int, reserved: tuple[tuple[int, int], ...]) -> Column:
    """The block on the disk of the number-th free one (from 0): `first` and on, with the reserved ranges (ends included) left out."""
    at = number + first
    for low, high in sorted(reserved):
        at = F.when(at >= low, at + (high - low + 1)).otherwise(at)
    return at.cast("long")


def chains(files: DataFrame, size: str, unit: int, order: str, keys: tuple[str, ...] = ("disk_id",), first: int = 0, end: int = 1 << 62, reserved: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """(keys, order, nth, block, next, bytes): every block that a file takes, in the order of the file, and its link.

    Files lie one after the other from block `first` on; reserved ranges are skipped, and what lies from block `end` on is
    cut off. `bytes` is what the block holds; `next` is null for the last block of a file. Files without bytes take none.
    """
    held = allocate(files, size, unit, order, keys).where("blocks > 0")
    # Only the blocks before the end are made, however long a file is.
    free = end - first - sum(high - low + 1 for low, high in reserved if low < end)
    last = F.least(F.col("blocks") - 1, F.lit(free - 1) - F.col("first_block"))
    spread = held.where(F.col("first_block") < free).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    number = F.col("first_block") + F.col("nth")
    told = spread.withColumns({"block": place(number, first, reserved), "next": F.when(F.col("nth") < F.col("blocks") - 1, place(number + 1, first, reserved))})
    return told.select(*keys, order, "nth", "block", "next", F.least(F.lit(unit), F.expr(size) - F.col("nth") * unit).cast("long").alias("bytes"))


def track_sector(block: Column, zones: tuple[tuple[int, int], ...]) -> tuple[Column, Column]:
    """The track (from 1) and sector of a block of a disk whose zones are (tracks, sectors a track)."""
    track, sector, begun, tracks = F.lit(None).cast("long"), F.lit(None).cast("long"), 0, 0
    for count, sectors in zones:
        here = (block >= begun) & (block < begun + count * sectors)
        track = F.when(here, F.floor((block - begun) / F.lit(sectors)) + tracks + 1).otherwise(track)
        sector = F.when(here, (block - begun) % sectors).otherwise(sector)
        begun, tracks = begun + count * sectors, tracks + count
    return track.cast("long"), sector.cast("long")


# The zones of a 1541 disk as (tracks, sectors a track); track 18 holds the directory.
ZONES_1541 = ((17, 21), (7, 19), (6, 18), (5, 17))
DIRECTORY_1541 = (17 * 21, 17 * 21 + 18)
# The sectors of an Atari DOS disk that hold its tables.
RESERVED_ATARI = (360, 368)
