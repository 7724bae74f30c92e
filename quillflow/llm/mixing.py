"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one stream that is cut into blocks of fixed length.  A source gets a whole number
of slots, as many as its target needs, and every slot is dealt to an output shard by a hash of its number.  The
counts of a source over the shards are thus multinomial, given its total, and the counts of a shard are
multinomial over the sources, given what the sources have in all: drawn without that condition, a source of
few blocks would miss its target by several per cent.  A source's k-th slot is mapped through a pseudorandom
permutation of its block indices (a new one for each pass over the source), and slots meet blocks by index.

No source is handled in one task: positions in a stream are prefix sums over hashed buckets, slots are
enumerated by ranges that are dealt to tasks before they are spread out, a source's shards are numbered by
ranges too, and a permutation is computed index by index (swap-or-not rounds), without a sort.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quality_rules import let
from .scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Words of a block, slots of an output shard, most passes over a source, weights dealt to the sources in turn.
BLOCK, SHARD_SLOTS, PASSES, WEIGHTS = 128, 4096, 3, (1, 2, 3)
#: Buckets that a source's stream is summed in, slots (and shards of a source) enumerated at once, rounds of the permutation, seed of all draws.
BUCKETS, SLOT_RANGE, ROUNDS, SEED = 1024, 1 << 14, 8, 17


def source_key(source: Column) -> Column:
    """A key that is never null and tells a null source from any name."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def placed(docs: DataFrame, *payload: str, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row with size, src and its place (bucket, number) in its source's stream, plus columns to carry along.

    Rows that agree in key, size and payload are interchangeable; the order of others doesn't depend on the run.
    """
    sized = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        source_key(F.col(source)).alias("src"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("_h"),
        *payload,
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "_h"), F.lit(BUCKETS)).cast("int"))
    order = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", "_h")
    return sized.withColumns({"number": F.row_number().over(order), "within": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")}).drop("_h")


def targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per source from (src, size): source_size, target, blocks, and the slots it should get as an interval.

    The weights share all words; a target stops at PASSES times its source's size and the excess is reshared by
    weight.  With sources in ascending order of cap per weight, the level (words per unit of weight) that is
    left after the first k have reached their caps is largest at the right k.
    """
    summed = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("src").startswith("n"), "src")  # a null source comes last
    weights = F.array(*map(F.lit, WEIGHTS))
    weighed = summed.withColumn("weight", F.get(weights, (F.row_number().over(named) - 1) % len(WEIGHTS)).cast("double")).withColumn("cap", PASSES * F.col("source_size").cast("double"))
    every, below = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    levelled = weighed.withColumn("level", left / weight_left).withColumn("level", F.max("level").over(every))
    full = F.col("level") * F.col("weight") >= F.col("cap")
    wanted = levelled.withColumns({"full": full, "target": F.when(full, F.col("cap")).otherwise(F.col("level") * F.col("weight")), "blocks": F.ceil(F.col("source_size") / F.lit(block)).cast("long")})
    # sources at their cap come first: their bounds are whole numbers, so each gets exactly PASSES slots a block
    slots = F.when(F.col("full"), (PASSES * F.col("blocks")).cast("double")).otherwise(F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0)))
    in_order = Window.orderBy(~F.col("full"), "src")
    bounded = wanted.withColumn("slots", slots).withColumn("slot_to", F.sum("slots").over(in_order))
    return bounded.withColumn("slot_from", F.lag("slot_to", 1, 0.0).over(in_order)).select("src", "source_size", "target", "blocks", "slot_from", "slot_to")


def slot_totals(sources: DataFrame) -> DataFrame:
    """(src, blocks, slots): whole numbers of slots, each within one of what the source should get, and so is their sum."""
    return sources.select("src", "blocks", (F.round("slot_to") - F.round("slot_from")).cast("long").alias("slots")).where("slots > 0")


def tasks_for(totals: DataFrame) -> int:
    """How many tasks to spread the slots over: AQE judges rows before they are spread out, and would take one."""
    return max(1, ceil((totals.agg(F.sum("slots")).first()[0] or 0) / SLOT_RANGE))


def shard_counts(totals: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(src, blocks, shard, count): how many slots of each source every output shard draws.

    Slot j of a source goes to a shard by a hash of (seed, source, j), whatever the other slots do.
    """
    shards = F.greatest(F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy()) / shard_slots)).cast("long")  # one row a source
    ranged = totals.withColumn("shards", shards).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_RANGE))).alias("r"))
    last = F.least("slots", (F.col("r") + 1) * SLOT_RANGE) - 1
    slots = ranged.repartition(tasks_for(totals), "src", "r").select("src", "blocks", "shards", F.explode(F.sequence(F.col("r") * SLOT_RANGE, last)).alias("j"))
    return slots.groupBy("src", "blocks", F.pmod(F.xxhash64(F.lit(seed), "src", "j"), "shards").alias("shard")).agg(F.count(F.lit(1)).alias("count"))


def permuted(x: Column, n: Column, *keys: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, chosen by keys, at x: swap-or-not rounds, each its own inverse."""

    def turn(at: Column, k: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*keys, k), n) - at, n)
        return let(partner, lambda p: F.when(F.xxhash64(*keys, k, F.greatest(at, p), F.lit("swap")).bitwiseAND(F.lit(1)) == 1, p).otherwise(at))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def numbered(counts: DataFrame) -> DataFrame:
    """counts with before: the slots of the source in the shards before, summed within ranges of shards first."""
    ranged = counts.withColumn("r", F.floor(F.col("shard") / SLOT_RANGE))
    sums = ranged.groupBy("src", "r").agg(F.sum("count").alias("n"))
    offsets = sums.select("src", "r", (F.sum("n").over(Window.partitionBy("src").orderBy("r")) - F.col("n")).alias("offset"))
    inside = F.sum("count").over(Window.partitionBy("src", "r").orderBy("shard")) - F.col("count")
    return ranged.withColumn("inside", inside).join(offsets, ["src", "r"]).withColumn("before", F.col("offset") + F.col("inside")).drop("r", "inside", "offset")


def picks(counts: DataFrame, tasks: int, seed: int = SEED) -> DataFrame:
    """(src, shard, block, turn): the block that each slot takes; turn is the pass over the source."""
    spread = numbered(counts).repartition(tasks, "src", "shard")
    slots = spread.select("src", "blocks", "shard", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("count") - 1)).alias("k"))
    turned = slots.withColumns({"turn": F.floor(F.col("k") / F.col("blocks")), "k": F.col("k") % F.col("blocks")})
    return turned.select("src", "shard", permuted(F.col("k"), F.col("blocks"), F.lit(seed), F.col("src"), F.col("turn")).alias("block"), F.col("turn").cast("int").alias("turn"))


class Mix:
    """The steps of a mix over one table, kept so that they can be looked at; see mixed_sizes and mixed_documents."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        self.block = block
        self.rows = stored(placed(docs), "mix-rows")
        self.sources = stored(targets(self.rows, block).coalesce(1), "mix-sources")
        totals = slot_totals(self.sources)
        self.counts = stored(shard_counts(totals, shard_slots, seed), "mix-shards")
        self.picks = picks(self.counts, tasks_for(totals), seed)

    def pieces(self) -> DataFrame:
        """Each row's overlaps with blocks: block, first and stop as word numbers in the text; one row without block if it has no words."""
        sums = self.rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
        before = sums.select("src", "bucket", (F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("before"))
        at = self.rows.join(before, ["src", "bucket"]).withColumn("start", F.col("before") + F.col("within"))
        blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / self.block), F.floor((F.col("start") + F.col("size") - 1) / self.block)))
        cut = at.select("src", "bucket", "number", "doc_id", "size", "start", F.explode_outer(blocks).alias("block"))
        return cut.select(
            "src", "bucket", "number", "doc_id", "size", "block",
            (F.greatest(F.col("start"), F.col("block") * self.block) - F.col("start")).alias("first"),
            (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block) - F.col("start")).alias("stop"),
        )

    def mixed_sizes(self) -> DataFrame:
        """(doc_id, src, size, source_size, target, taken): one row per input row."""
        # picks grow with the corpus, and their estimate, from before the explode, says otherwise: no broadcast
        times = self.picks.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
        found = self.pieces().join(times, ["src", "block"], "left")
        taken = F.coalesce(F.sum((F.col("stop") - F.col("first")) * F.col("times")), F.lit(0)).cast("long")
        by_row = found.groupBy("src", "bucket", "number", "doc_id", "size").agg(taken.alias("taken"))
        return by_row.join(self.sources, "src").select("doc_id", "src", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: how many words of it the mix takes, repeats counted.

    A null source is a source of its own, the last; null and empty texts have size 0 and are never taken.  No
    row is taken more than PASSES times its size, as no block is.  Rows that repeat, or share a key, are rows of
    their own; those that agree in all are interchangeable.  A very long text spans many blocks.  An empty
    table gives an empty one.
    """
    return Mix(docs, block, shard_slots, seed).mixed_sizes().select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as documents, with the columns doc_id, text, lang, source and n_chars: one row for each pass that takes any of a document.

    A document that a pass takes whole keeps its text; of others the taken words remain, joined by one space.
    Null keys, languages and sources stay null; a null, empty or wordless text is never taken.
    """
    mixed = Mix(docs, block, shard_slots, seed)
    taken = mixed.pieces().join(mixed.picks.hint("merge"), ["src", "block"]).groupBy("src", "bucket", "number", "turn").agg(F.sort_array(F.collect_list(F.struct("first", "stop"))).alias("runs"), F.sum(F.col("stop") - F.col("first")).alias("words"))
    whole = placed(docs, "text", "lang", "source").join(taken.hint("merge"), ["src", "bucket", "number"])
    words = F.array_remove(F.split("text", SPACE), "")
    cut = let(words, lambda w: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(w, r["first"].cast("int") + 1, (r["stop"] - r["first"]).cast("int")))), " "))
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(cut)
    return whole.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))
