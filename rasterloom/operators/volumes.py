"""Disk images read as relations: blocks, directories, chains of pointers and the files behind them, with built-in functions only.

An image becomes a table of those of its blocks that are asked for once; what points from block to block is a small table
beside it, and following the pointers goes in rounds over that table alone. disks(disk_id, content) as binaries. An image
whose pointers go in a circle is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import settle


def blocks_of(disks: DataFrame, size: int = 512, start: int = 0, kept: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """(disk_id, block, last, data): the blocks of each image from byte `start` on, numbered from 0 to `last`; of these only
    the ones for which kept(data, block, last) is true, if that is given."""
    last = F.expr(f"(octet_length(content) - {start}) div {size} - 1")

    def cut(image: Column) -> Column:
        own = lambda k: F.struct(k.alias("block"), image["last"].alias("last"), F.substring(image["content"], (k * size + start + 1).cast("int"), F.lit(size)).alias("data"))
        every = F.transform(F.sequence(F.lit(0).cast("long"), image["last"]), own)
        return F.filter(every, lambda b: kept(b["data"], b["block"], b["last"])) if kept else every

    # The image is bound once: taken from its row, it would be copied as a whole for each of its blocks.
    blocks = F.transform(F.array(F.struct("content", last.cast("long").alias("last"))), cut)[0]
    return disks.where(F.octet_length("content") >= start + size).select("disk_id", F.explode(blocks).alias("b")).select("disk_id", "b.block", "b.last", "b.data")


def number(data: Column, at: Column | int, length: int, little: bool = False) -> Column:
    """The unsigned number of `length` bytes at a place of a binary."""
    at = F.lit(at) if isinstance(at, int) else at
    own = F.substring(data, (at + 1).cast("int"), F.lit(length))
    if little and length > 1:
        return sum((number(data, at + k, 1) * (1 << (8 * k)) for k in range(length)), F.lit(0).cast("long"))
    return F.conv(F.hex(own), 16, 10).cast("long")


def _followed(first: DataFrame, links: DataFrame) -> DataFrame:
    """(disk_id, block) of first(disk_id, block) and of all that links(disk_id, block, next) lead to, a step of all images a
    round."""
    links = settle(links.where("next > 0").select("disk_id", "block", "next"))
    most = links.groupBy("disk_id").count().agg(F.max("count")).first()[0] or 0
    walked = [settle(first)]
    while not walked[-1].isEmpty():
        if len(walked) > most + 1:
            raise ValueError("pointers go in a circle")
        walked.append(settle(walked[-1].join(links, ["disk_id", "block"]).select("disk_id", F.col("next").alias("block"))))
    return reduce(DataFrame.union, walked)


def amiga_listing(disks: DataFrame) -> DataFrame:
    """(disk_id, name, size, kind) of the root directory: 72 chains by hash, from the root block in the middle of the disk."""
    # Header blocks say so in their first word; only they are followed.
    header = lambda data: F.substring(data, 1, 4) == F.lit(bytes((0, 0, 0, 2)))
    middle = lambda block, last: block == F.call_function("div", last + 1, F.lit(2))
    held = settle(blocks_of(disks, kept=lambda data, block, last: header(data) | middle(block, last)))
    entries = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda k: number(F.col("data"), k * 4 + 24, 4))
    roots = held.where(middle(F.col("block"), F.col("last"))).select("disk_id", F.explode(entries).alias("block")).where("block > 0")
    heads = held.where(header(F.col("data"))).select(
        "disk_id",
        "block",
        number(F.col("data"), 496, 4).alias("next"),
        F.decode(F.substring("data", F.lit(434), number(F.col("data"), 432, 1).cast("int")), "ISO-8859-1").alias("name"),
        number(F.col("data"), 324, 4).alias("size"),
        F.when(number(F.col("data"), 508, 4) == (1 << 32) - 3, "FILE").otherwise("DIR").alias("kind"),
    )
    heads = settle(heads)
    return _followed(roots, heads).join(heads, ["disk_id", "block"]).select("disk_id", "name", "size", "kind")


def cpc_listing(disks: DataFrame) -> DataFrame:
    """(disk_id, name, size): 64 directory entries of 32 bytes; a file's size is 128 times the records of its extents."""
    entries = blocks_of(disks.withColumn("content", F.substring("content", 1, 512 + 2048)), 32, 512)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(11)), lambda k: F.chr(number(F.col("data"), k, 1).bitwiseAND(F.lit(127).cast("long")))), "")
    used = entries.where(number(F.col("data"), 0, 1) <= 31).select("disk_id", text.alias("text"), number(F.col("data"), 15, 1).alias("records"))
    stem, extension = F.rtrim(F.substring("text", 1, 8)), F.rtrim(F.substring("text", 9, 3))
    named = used.withColumn("name", F.when(F.length(extension) > 0, F.concat(stem, F.lit("."), extension)).otherwise(stem))
    return named.groupBy("disk_id", "name").agg((F.sum("records") * 128).alias("size"))


def prodos_entries(held: DataFrame) -> DataFrame:
    """(disk_id, last, nth, name, kind, key, size) of the volume directory of blocks_of(); kind: 1 one block, 2 an index block, 3 a
    block of index blocks."""
    links = held.select("disk_id", "block", number(F.col("data"), 2, 2, True).alias("next"))
    directory = _followed(links.where("block = 2").select("disk_id", "block"), links).join(held, ["disk_id", "block"])
    entry = lambda k: F.struct(k.alias("k"), F.substring("data", (k * 39 + 5).cast("int"), F.lit(39)).alias("e"))
    spread = directory.select("disk_id", "last", "block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(12)), entry)).alias("p")).where("block > 2 or p.k > 0")
    kind = number(F.col("p.e"), 0, 1)
    told = spread.select("disk_id", "last", (F.col("block") * 13 + F.col("p.k")).alias("nth"), F.decode(F.substring("p.e", F.lit(2), kind.bitwiseAND(F.lit(15).cast("long")).cast("int")), "US-ASCII").alias("name"), F.call_function("shiftright", kind, F.lit(4)).alias("kind"), number(F.col("p.e"), 17, 2, True).alias("key"), number(F.col("p.e"), 21, 3, True).alias("size"))
    return told.where("kind between 1 and 3")


def _pointed(rows: DataFrame, held: DataFrame, span: int) -> DataFrame:
    """rows(disk_id, last, nth, key, base, ...) with the blocks that the index block `key` points to: `key` becomes the block,
    `base` grows by its place. A pointer stands for `span` bytes; those beyond the file's size are left alone."""
    pointer = lambda k: F.struct(k.alias("k"), (number(F.col("data"), k, 1) + number(F.col("data"), k + 256, 1) * 256).alias("to"))
    own = held.select("disk_id", F.col("block").alias("key"), "data")
    joined = rows.where(f"key <= last and base * {256 * span} < greatest(size, 1)").join(own, ["disk_id", "key"], "left")
    until = F.expr(f"cast(least(255, (greatest(size, 1) - 1) div {span} - base * 256) as int)")
    read = joined.withColumns({"data": F.coalesce(F.when(F.col("key") > 0, F.col("data")), F.lit(bytes(512))), "until": until})
    spread = read.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("until")), pointer))).drop("data", "until")
    return spread.withColumns({"key": F.col("p.to"), "base": F.col("base") * 256 + F.col("p.k")}).drop("p")


def prodos_files(disks: DataFrame) -> DataFrame:
    """(disk_id, name, content) of every file, through its index blocks. A pointer of 0 is a block of zeros; a file ends at its
    size. Blocks of zeros are not held: one that is not there reads as zeros."""
    held = settle(blocks_of(disks, kept=lambda data, block, last: data != F.lit(bytes(512))))
    entries = settle(prodos_entries(held).withColumn("base", F.lit(0).cast("long")))
    indexed = entries.where("kind = 2").unionByName(_pointed(entries.where("kind = 3"), held, 256 * 512))
    places = entries.where("kind = 1").unionByName(_pointed(indexed, held, 512))
    data = places.join(held.select("disk_id", F.col("block").alias("key"), "data"), ["disk_id", "key"], "left")
    # Bytes as characters of one byte each, dealt by file once; a line of 64 blocks comes together before its file does.
    text = F.decode(F.coalesce(F.when(F.col("key") > 0, F.col("data")), F.lit(bytes(512))), "ISO-8859-1").alias("text")
    parts = data.select("disk_id", "nth", F.expr("base div 64").alias("line"), F.col("base").alias("at"), text).repartition("disk_id", "nth")
    joined = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda p: p["text"]), "").alias("text")
    files = parts.groupBy("disk_id", "nth", "line").agg(joined("at")).groupBy("disk_id", "nth").agg(joined("line"))
    whole = files.withColumn("content", F.encode("text", "ISO-8859-1")).join(entries.select("disk_id", "nth", "name", "size"), ["disk_id", "nth"])
    return whole.select("disk_id", "name", F.substring("content", F.lit(1), F.col("size").cast("int")).alias("content"))
