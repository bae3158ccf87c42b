"""Selection, settings, validation, naming, allocation and summaries of batches of images and files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected_or_all(rows: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """The rows whose key is selected, or all rows if nothing is."""
    any_chosen = selected.select(F.lit(1).alias("__any")).limit(1)
    chosen = selected.select(F.col(key), F.lit(True).alias("__on")).distinct()
    told = rows.join(chosen, key, "left").join(F.broadcast(any_chosen), F.lit(True), "left")
    return told.where(F.col("__any").isNull() | F.col("__on")).drop("__any", "__on")


def resolve_settings(rows: DataFrame, locked: DataFrame, key: str, machine: str, defaults: dict[str, str]) -> DataFrame:
    """Locked settings of a row where there are any for this machine, else the defaults; missing keys fall back one by one."""
    own = locked.where(F.col("machine") == machine).select(key, F.col("settings").alias("__own"))
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return rows.join(own, key, "left").withColumn("settings", F.when(F.col("__own").isNull(), base).otherwise(F.map_zip_with(base, "__own", lambda k, a, b: F.coalesce(b, a)))).drop("__own")


def validate_size(rows: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """`error`: emptyImage for 0 by 0, invalidDimensions for another side that is not positive, else null."""
    empty = (F.col(width) == 0) & (F.col(height) == 0)
    return rows.withColumn("error", F.when(empty, "emptyImage").when((F.col(width) <= 0) | (F.col(height) <= 0), "invalidDimensions"))


def summary(results: DataFrame, name: str = "name", error: str = "error", order: str = "ord") -> DataFrame:
    """One row: n, failed, and the first three failed names with how many more there are."""
    bad = F.col(error).isNotNull()
    firsts = results.where(bad).orderBy(order).limit(3).agg(F.sort_array(F.collect_list(F.struct(order, name))).alias("__firsts"))
    counts = results.agg(F.count("*").alias("n"), F.count_if(bad).alias("failed"))
    names = F.concat_ws(", ", F.transform("__firsts", lambda f: f[name]))
    more = F.when(F.col("failed") > 3, F.concat(F.lit(" and "), F.col("failed") - 3, F.lit(" more"))).otherwise("")
    return counts.join(F.broadcast(firsts), F.lit(True)).select("n", "failed", F.concat(names, more).alias("failures"))


#: Name rules by system: characters dropped (a negated class), and the length.
NAME_RULES = {
    "cbm": ("[^A-Z0-9 _-]", 16),
    "atari": ("[^A-Z0-9]", 8),
    "fat": ("[^A-Z0-9_~-]", 8),
    "msx": ("[^A-Z0-9_]", 8),
    "st": ("[^A-Z0-9_-]", 8),
    "cpc": ("[^A-Z0-9]", 8),
    "bbc": ("[^A-Z0-9]", 7),
    "trd": ("[^A-Z0-9]", 8),
    "coco": ("[^A-Z0-9]", 8),
    "amiga": ("[:/]", 30),
}


def clean_name(name: Column, system: str) -> Column:
    """The name as a directory holds it: upper case, without its extension, unwanted characters dropped, cut to length.

    The Amiga keeps case and full stops, and of a path only what follows the last slash. On BBC disks a first letter with a
    full stop after it names the directory and is no part of the name. What is left may be empty; a null name is FILE.
    """
    drop, length = NAME_RULES[system]
    if system == "amiga":
        folded = F.regexp_replace(name, r"^[\s\S]*/", "")
    else:
        folded = base_name(F.upper(name))
        if system == "bbc":
            folded = F.when((F.length(folded) > 2) & (F.substring(folded, 2, 1) == "."), F.substring(folded, F.lit(3), F.length(folded))).otherwise(folded)
    return F.coalesce(F.substring(F.regexp_replace(folded, drop, ""), 1, length), F.lit("FILE"))


def clean_extension(name: Column, length: int = 3) -> Column:
    """Letters and digits after the last full stop, in upper case; empty without one."""
    return F.when(F.instr(name, ".") > 0, F.substring(F.regexp_replace(F.regexp_extract(F.upper(name), r"\.([^.]*)$", 1), "[^A-Z0-9]", ""), 1, length)).otherwise("")


def clean_prodos(name: Column) -> Column:
    """Letters, digits and full stops, the first a letter (else A in front), at most 15; UNNAMED if nothing is left."""
    kept = F.substring(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{M}\p{N}.]", ""), 1, 15)
    return F.when(F.length(kept) == 0, "UNNAMED").otherwise(F.substring(F.when(kept.rlike(r"^\p{L}"), kept).otherwise(F.concat(F.lit("A"), kept)), 1, 15))


#: ProDOS types by extension, as type, auxiliary type and the extension on the disk; others are BIN.
PRODOS_TYPES = {"SHR": (0xC1, 0x0000, "PIC"), "A2GS": (0xC1, 0x0000, "PIC"), "3200": (0xC1, 0x0002, "PIC"), "BIN": (0x06, 0x2000, "BIN")}


def prodos_type(extension: Column) -> Column:
    """(type, aux, extension) of a file by its extension, in any case."""
    kind = lambda t: F.struct(F.lit(t[0]).cast("long").alias("type"), F.lit(t[1]).cast("long").alias("aux"), F.lit(t[2]).alias("extension"))
    table = F.create_map(*[x for k, t in PRODOS_TYPES.items() for x in (F.lit(k), kind(t))])
    return F.coalesce(F.element_at(table, F.upper(extension)), kind(PRODOS_TYPES["BIN"]))


def cbm_bytes(name: Column, length: int = 16) -> Column:
    """A name as CBM disks hold it, in hex: small letters become capitals, padded with shifted spaces."""
    return F.rpad(F.hex(F.encode(F.translate(F.substring(name, 1, length), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "ISO-8859-1")), 2 * length, "A0")


def prodos_date(when: Column) -> Column:
    """A date as ProDOS packs it: seven bits of year, four of month, five of day."""
    return ((F.year(when) % 100) * 512 + F.month(when) * 32 + F.day(when)).cast("long")


def amiga_days(when: Column) -> Column:
    """Days since the first of January 1978."""
    return F.datediff(when, F.lit("1978-01-01").cast("date")).cast("long")


def available(rows: DataFrame, options: dict[str, list[str]], system: str, option: str, out: str = "option") -> DataFrame:
    """`out`: the chosen option where its system has it, else the system's first; options is a table of a few rows."""
    table = F.create_map(*[x for k, v in options.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in v]))])
    own = F.element_at(table, F.col(system))
    return rows.withColumn(out, F.when(F.array_contains(own, F.col(option)), F.col(option)).otherwise(F.element_at(own, 1)))


def assets(results: DataFrame, name: str, parts: str) -> DataFrame:
    """One row for each asset of each result, named after it, with a number where there is more than one."""
    spread = results.withColumn("__n", F.size(parts)).select("*", F.posexplode(parts).alias("__at", "asset"))
    told = F.when(F.col("__n") > 1, F.concat(F.col(name), F.lit("_"), F.col("__at") + 1)).otherwise(F.col(name))
    return spread.withColumn("asset_name", told).drop("__n", "__at", parts)


def base_name(name: Column) -> Column:
    """The name up to its last full stop; a name without one stays whole."""
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name)


def _fit(batches: Iterator[pa.RecordBatch], keys: int, capacity: int, entries: int, when_full: str) -> Iterator[pa.RecordBatch]:
    """The fold over rows that come by disk and in order: columns are the keys, ord, need. A disk's state is three numbers."""
    disk, used, files, ended = None, 0, 0, False
    for batch in batches:
        kept: list[tuple[int, int, int]] = []
        own = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
        for row, (key, need) in enumerate(zip(own, batch.column(keys + 1).to_pylist(), strict=True)):
            if row == 0 and disk is None or key != disk:
                disk, used, files, ended = key, 0, 0, False
            room = capacity - used
            stored = min(need, room) if when_full == "truncate" else need
            if not ended and files < entries and stored <= room and (stored > 0 or need == 0):
                kept.append((row, stored, used))
                used, files = used + stored, files + 1
            elif when_full == "stop":
                ended = True
        at = pa.array([k[0] for k in kept], pa.int64())
        names = [*batch.schema.names[: keys + 1], "stored", "first"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(keys + 1)), *(pa.array([k[c] for k in kept], pa.int64()) for c in (1, 2))], names=names)


def fit(files: DataFrame, size: str, unit: int, capacity: int, entries: int, order: str, keys: tuple[str, ...] = ("disk_id",), when_full: str = "skip") -> DataFrame:
    """Which files a disk takes, in order, by a fold that reads a disk's files as they come and holds none of them.

    when_full: skip goes on with the next file, stop ends the disk, truncate stores what fits and goes on.
    (keys, ord, stored blocks, first block).
    """
    listed = files.select(*keys, F.col(order).cast("long").alias("ord"), F.expr(f"({size} + {unit - 1}) div {unit}").cast("long").alias("need"))
    types = dict(listed.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", ord long, stored long, first long"
    return listed.repartition(*keys).sortWithinPartitions(*keys, "ord").mapInArrow(partial(_fit, keys=len(keys), capacity=capacity, entries=entries, when_full=when_full), schema)


def size_text(size: Column, base: int = 1024) -> Column:
    """A byte count for people: B below the base, then KB and MB with one decimal."""
    return F.when(size < base, F.format_string("%d B", size)).when(size < base * base, F.format_string("%.1f KB", size / base)).otherwise(F.format_string("%.1f MB", size / (base * base)))
