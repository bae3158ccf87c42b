"""Mixing sources to target weights, with DataFrame operations only.

Words of a source form one stream (documents in hash order), packed into blocks of `block` words, the last one shorter.
Every output shard of `shard` slots draws multinomial source counts; the slots of a source, counted over the shards, run
through pseudorandom permutations of its block indices, a new one for each pass, and blocks are joined by their index.
What a source was drawn too often is cut and what it was drawn too seldom is settled in a last shard, so that its taken
words equal its target, rounded; the last slot of a source is cut to the word.

Targets: sources by code point, null last, weigh `weights`, repeating, and share all words; a target stops at
`most` times its source's words and the excess is reshared by weight until none is above.

Null or blank text has size 0, and takes nothing. A null source is a source of its own. Repeated rows and repeated or
null ids count each on their own. No rows give no rows. A source without words has target 0. Tables of one row a source
are ordered in one task; all else is dealt by source and bucket, shard or block, so that a hot source spreads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, let

ROUNDS = 4
STEPS = 8
PER_TASK = 1 << 18


def _feistel(x: Column, left: Column, right: Column, key: Column, back: bool = False) -> Column:
    """A keyed bijection of 0 .. left * right - 1, or its inverse."""
    b = F.pmod(x, right)
    a = F.call_function("div", x - b, right)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            b = F.pmod(b - F.pmod(F.xxhash64(key, F.lit(2 * i + 1), a), right), right)
            a = F.pmod(a - F.pmod(F.xxhash64(key, F.lit(2 * i), b), left), left)
        else:
            a = F.pmod(a + F.pmod(F.xxhash64(key, F.lit(2 * i), b), left), left)
            b = F.pmod(b + F.pmod(F.xxhash64(key, F.lit(2 * i + 1), a), right), right)
    return a * right + b


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes(source_key, source, source_size) with target added. One row per source: the windows run over sources only."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    stop = F.lit(float(most)) * F.col("source_size")
    order = Window.orderBy(stop / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # In order of size per weight, those before the first that keeps its share are stopped.
    share = (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum(stop).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    shared = weighed.withColumns({"stop": stop, "share": share})
    level = F.min_by("share", F.when(F.col("stop") / F.col("weight") >= F.col("share"), F.struct(F.col("stop") / F.col("weight"), F.col("rank")))).over(whole)
    return shared.withColumn("target", F.least("stop", F.coalesce(level * F.col("weight"), F.col("stop")))).drop("rank", "weight", "stop", "share")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 512, shard: int = 16384, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0) -> DataFrame:
    """One row per input row: id_col, size, source_size, target (its source's), taken (its words in the mix, repeats counted)."""
    return _mix(docs, id_col, text_col, source_col, block, shard, weights, most, seed).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, shard: int, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """mix() with the columns source_key and finger, a hash of the text."""
    source, text = F.col(source_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("source_key"),
        source.alias("source"),
        F.xxhash64(text).alias("finger"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long").alias("size"),
    )
    # By id, source and text together: rows without an id, or of one id, are dealt out too.
    sized = cut(sized.withColumn("order", F.xxhash64("id", "source_key", "finger", F.lit(seed))), "sized")
    # As many buckets as each holds rows, about: sums of buckets and sums within one are equally small.
    buckets = 16 + int(sized.count() ** 0.5)
    sized = sized.withColumn("bucket", F.pmod("order", F.lit(buckets)))

    # Where each document begins in its source's stream: sums of buckets, then sums within a bucket.
    sums = cut(sized.groupBy("source_key", "source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_start"))
    within = Window.partitionBy("source_key", "bucket").orderBy("order", "id", "size", "finger")
    placed = sized.withColumns({"row": F.row_number().over(within), "inner": F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    placed = placed.join(begins, ["source_key", "bucket"]).select("id", "source_key", "finger", "bucket", "row", "size", (F.col("bucket_start") + F.col("inner")).alias("start"))

    # Per source: passes over all its blocks, then `rest` words of one more pass, `slots` slots in all.
    plan = targets(sums.groupBy("source_key", "source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    n = F.col("source_size")
    plan = plan.withColumns({"words": F.when(n > 0, F.least(F.round("target").cast("long"), most * n)).otherwise(0), "blocks": F.expr(f"(source_size + {block - 1}) div {block}")})
    plan = plan.withColumns({"tail": n - (F.col("blocks") - 1) * block, "left": F.ceil(F.sqrt("blocks")).cast("long"), "passes": F.when(n > 0, F.expr("words div greatest(source_size, 1)")).otherwise(0)})
    plan = plan.withColumns({"right": F.when(F.col("blocks") > 0, F.expr("(blocks + `left` - 1) div greatest(`left`, 1)")).otherwise(1), "rest": F.col("words") - F.col("passes") * n})
    plan = plan.withColumn("tail_slot", _walk(F.col("blocks") - 1, F.col("passes"), seed, back=True))
    least = F.expr(f"(rest + {block - 1}) div {block}")
    short = (F.col("tail_slot") < least) & (least * block - (block - F.col("tail")) < F.col("rest"))
    plan = cut(plan.withColumn("slots", F.when(F.col("words") > 0, F.col("passes") * F.col("blocks") + least + short.cast("long")).otherwise(0)), "plan")

    uses = _uses(plan, block, shard, seed)
    blocks = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    pieces = placed.withColumn("index", F.explode_outer(F.when(F.col("size") > 0, blocks)))
    lo, hi = F.greatest("start", F.col("index") * block), F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block)
    part = F.greatest(F.lit(0), F.least(hi, F.col("index") * block + F.coalesce("part", F.lit(0))) - lo)
    taken = F.sum(F.coalesce((hi - lo) * F.coalesce("times", F.lit(0)) + part, F.lit(0)))
    mixed = pieces.join(uses, ["source_key", "index"], "left").groupBy("source_key", "bucket", "row", "id", "finger", "size").agg(taken.alias("taken"))
    return mixed.join(plan.select("source_key", "source_size", "target"), "source_key")


def _walk(x: Column, turn: Column, seed: int, back: bool = False) -> Column:
    """The permutation of 0 .. blocks - 1 for one pass over a source: the bijection, repeated until it is in range.

    STEPS steps end nearly every walk; the others go on for as many steps as the bijection has numbers out of range,
    which no walk outlasts, since it meets each of them once at most.
    """
    left, right, blocks = F.col("left"), F.col("right"), F.col("blocks")
    key = F.xxhash64("source_key", turn, F.lit(seed))
    step = lambda at: _feistel(at, left, right, key, back)
    walk = lambda at, steps: F.aggregate(F.sequence(F.lit(1).cast("long"), steps), at, lambda a, _: F.when(a < blocks, a).otherwise(step(a)))
    walked = let(walk(step(x), F.lit(STEPS).cast("long")), lambda at: F.when(at < blocks, at).otherwise(walk(at, F.greatest(left * right - blocks, F.lit(1).cast("long")))))
    return F.when(blocks > 1, walked).otherwise(F.lit(0).cast("long"))


def _uses(plan: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """(source_key, index, times, part): how often a block is taken whole, and the words of it that a last slot takes."""
    spark = plan.sparkSession
    total, sources = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    # A guide table: a slot's uniform number falls into a cell, and a cell knows the few sources that reach into it.
    cells = 4 * max(1, sources)
    share = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, 0)
    ranges = plan.where("slots > 0").withColumn("hi", F.sum("slots").over(share)).withColumn("lo", F.col("hi") - F.col("slots"))
    scale = F.lit(float(cells) / max(1, total))
    guide = ranges.select("source_key", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * scale).cast("long"), F.floor(F.col("hi") * scale).cast("long"))).alias("cell"))
    drawn = spark.range(total).select(F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed), F.lit("draw")), F.lit(max(1, total))).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") * scale).cast("long"))
    counts = drawn.join(guide, "cell").where("u >= lo and u < hi").groupBy("source_key", "shard").agg(F.count("*").alias("count"))
    counts = cut(counts, "draws")
    upto = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.withColumn("first", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    lines = begun.join(plan, "source_key").withColumn("count", F.least("count", F.col("slots") - F.col("first"))).where("count > 0")
    drawn_so_far = counts.groupBy("source_key").agg(F.sum("count").alias("first"))
    settled = plan.join(drawn_so_far, "source_key", "left").withColumn("first", F.coalesce("first", F.lit(0))).withColumn("count", F.col("slots") - F.col("first")).where("count > 0").withColumn("shard", F.lit(-1).cast("long"))
    # Few rows that become many slots: dealt by shard, a task for PER_TASK slots, or as many as a shuffle has by default.
    tasks = max(1, total // PER_TASK, min(-(-total // shard), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    lines = lines.unionByName(settled).repartition(tasks, "source_key", "shard")
    slots = lines.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    slots = slots.withColumns({"turn": F.expr("slot div blocks"), "at": F.expr("slot % blocks")})
    slots = slots.withColumn("index", _walk(F.col("at"), F.col("turn"), seed))
    length = F.when(F.col("index") == F.col("blocks") - 1, F.col("tail")).otherwise(block)
    before = F.col("at") * block - F.when(F.col("tail_slot") < F.col("at"), block - F.col("tail")).otherwise(0)
    take = F.when(F.col("turn") < F.col("passes"), length).otherwise(F.greatest(F.lit(0), F.least(length, F.col("rest") - before)))
    slots = slots.select("source_key", "index", length.alias("length"), take.alias("take"))
    return slots.groupBy("source_key", "index").agg(F.sum((F.col("take") == F.col("length")).cast("long")).alias("times"), F.max(F.when(F.col("take") < F.col("length"), F.col("take"))).alias("part"))


def draw_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 512, shard: int = 16384, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0) -> DataFrame:
    """The mix as rows of docs: a document stands as often as the mix takes its words; fractions are settled so that what a source draws is near what the mix takes of it.

    Rows are told apart by id, source and text: those with a null or repeated id are drawn each by their own share, and
    rows that are alike in all three share theirs evenly. Rows without words are in no block and drop out.
    """
    key = lambda c, kind: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n")).alias(kind)
    plan = _mix(docs, id_col, text_col, source_col, block, shard, weights, most, seed).where("taken > 0")
    keys = [key(F.col("id"), "id_key"), "source_key", "finger"]
    shares = cut(plan.groupBy(*keys).agg(F.avg(F.col("taken") / F.col("size")).alias("share"), F.max("size").alias("size"), F.count("*").alias("n")), "shares")
    # Fractions add up along rows of like size, each cell of a source and a size in an order by hash, and a copy is due where
    # their sum passes a whole number: what a source draws is near what it takes. Cells are dealt into parts, so none is large.
    named = ["id_key", "source_key", "finger"]
    mixed = F.xxhash64("id_key", "source_key", "finger", F.lit(seed), F.lit("copy"))
    cell = ["source_key", F.floor(4 * F.log2(F.col("size") * F.col("n"))), F.pmod(mixed, F.lit(1 + shares.count() // PER_TASK))]
    upto = F.sum("share").over(Window.partitionBy(*cell).orderBy(mixed, *named).rowsBetween(Window.unboundedPreceding, 0))
    due = lambda c: F.floor(c + 0.5 + 1e-9)
    copies = shares.withColumn("upto", upto).select(*named, (due(F.col("upto")) - due(F.col("upto") - F.col("share"))).cast("int").alias("copies")).where("copies > 0")
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), key(F.col(f"`{id_col}`"), "id_key"), key(F.col(f"`{source_col}`"), "source_key"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("finger"))
    drawn = told.join(copies, ["id_key", "source_key", "finger"]).select("whole", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return drawn.select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns])
