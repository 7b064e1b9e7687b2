"""Mixing sources to target weights, with DataFrame operations only.

The words of each source, its documents in a fixed pseudorandom order, form one stream that is cut
into blocks of block_words words. The mix is a row of slots, shard_slots to an output shard; each slot
takes one block. Every slot draws its source, so a shard's counts are a multinomial draw by the targets.
Over all shards the draws miss the targets by about the root of the number of slots; that many slots, the last ones of sources
drawn too often, go to the sources drawn too seldom, so the totals meet the targets to a slot. The k-th
slot of a source takes the block at the k-th place of a pseudorandom permutation of the block indices
(a swap-or-not shuffle: a bijection for any number of blocks), a new one for each pass over the source,
and blocks are joined with slots by index. No block is taken more often than passes are begun, so no
document more than ``most`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import fresh_prefix, session_of, stored

#: Words of a block, slots of an output shard, passes over a source at most, weights by the source's place.
BLOCK_WORDS, SHARD_SLOTS, MOST, WEIGHTS = 128, 1 << 13, 3, (1, 2, 3)
#: Documents in a chunk of a source's stream, about; copies of a row that one row is spread to; slots that a task makes.
_CHUNK_ROWS, _COPIES, _TASK_SLOTS = 1000, 4096, 1 << 17
#: Rounds of the shuffle of block indices; cells that a line of intervals is cut into.
_ROUNDS, _CELLS = 20, 1024
_WORD = r"[^\x20\x09-\x0D]+"


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, sid (its place by code point, from 1, null last), source_size, target from a table of source and size.

    Sources weigh weights[(sid - 1) mod n] and share the sum of all sizes; none gets more than
    ``most`` times its size, and what is over is shared again by weight. The table has one row for
    each source, so its windows see no more rows than there are sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sid = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    table = by_source.withColumn("sid", sid).withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size").cast("double") * most)
    # Sources reach their cap in order of cap / weight; the rest share what is left in proportion to weight.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    share = (F.sum("source_size").over(whole).cast("double") - before) / left
    table = table.withColumn("share", share).withColumn("place", F.row_number().over(order)).withColumn("free", F.col("cap") / F.col("weight") > F.col("share"))
    level = F.min(F.when(F.col("free"), F.struct("place", "share"))).over(whole)
    table = table.withColumn("level", level)
    target = F.when(F.col("level").isNull() | (F.col("place") < F.col("level.place")), F.col("cap")).otherwise(F.col("level.share") * F.col("weight"))
    return table.select("source", "sid", "source_size", target.alias("target"))


def _quota(targets: DataFrame, block_words: int, most: int) -> DataFrame:
    """Adds blocks (of the source) and slots (it fills), so that slots times the mean block come to the target."""
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    exact = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    # Rounded along the running sum, so that the mix as a whole is never more than a slot off.
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    table = targets.withColumn("blocks", blocks).withColumn("exact", exact)
    share = F.floor(F.sum("exact").over(upto) + 0.5) - F.floor(F.coalesce(F.sum("exact").over(before), F.lit(0.0)) + 0.5)
    near = F.greatest(F.floor("exact"), F.least(F.ceil("exact"), share))
    return table.withColumn("slots", F.least(near, F.col("blocks") * most).cast("long")).drop("exact")


def _placed(docs: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """One row for each document: sid, id, size, salt, source_size, target, position (where its words begin in its source's stream) and a number unique in its chunk.

    Positions are sums over chunks and, within a chunk, over its documents: no window holds a whole
    source's documents. Rows equal in id, size and text are one with a number of copies here, side by side in the
    stream, and so never fill a chunk; they are spread again at last.
    """
    chunks = max(1, rows // _CHUNK_ROWS)
    here = docs.groupBy("id", "source", "size", "salt").agg(F.count(F.lit(1)).alias("copies"))
    here = here.withColumn("chunk", F.pmod(F.xxhash64("id", "size", "salt"), F.lit(chunks)))
    here = here.join(targets, here["source"].eqNullSafe(targets["source"])).drop("source")
    inner = Window.partitionBy("sid", "chunk").orderBy("id", "size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("copies")
    zero = F.lit(0).cast("long")
    here = here.withColumn("within", F.coalesce(F.sum(words).over(inner), zero)).withColumn("number", F.coalesce(F.sum("copies").over(inner), zero))
    sums = here.groupBy("sid", "chunk").agg(F.sum(words).alias("chunk_size"))
    ahead = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "chunk", F.coalesce(F.sum("chunk_size").over(ahead), zero).alias("ahead"))
    here = here.join(sums, ["sid", "chunk"]).withColumn("position", F.col("ahead") + F.col("within")).drop("ahead", "within")
    keep = [c for c in here.columns if c != "copies"]
    # Many copies are spread by several tasks, _COPIES by a row.
    many = here.where(F.col("copies") > _COPIES).withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_COPIES})"))).repartition("sid", "chunk", "number", "part")
    many = many.withColumn("copy", F.explode(F.expr(f"sequence(part * {_COPIES}L, least(copies, (part + 1) * {_COPIES}L) - 1)")))
    few = here.where(F.col("copies") <= _COPIES).withColumn("part", zero).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    each = few.unionByName(many).withColumn("position", F.col("position") + F.col("copy") * F.col("size")).withColumn("number", F.col("number") + F.col("copy"))
    return each.select(*keep)


def _looked_up(points: DataFrame, point: str, lines: DataFrame, low: str, until: str, total: int) -> DataFrame:
    """points joined with the interval (low to before until, of 0 to total) that each point lies in, by equal cells of the line."""
    cell = max(1, total // _CELLS)
    cells = lines.where(F.col(until) > F.col(low)).withColumn("cell", F.explode(F.expr(f"sequence({low} div {cell}, ({until} - 1) div {cell})")))
    found = points.withColumn("cell", F.expr(f"{point} div {cell}")).join(cells, "cell").drop("cell")
    return found.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(until)))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """The place of index (0 to before n) in a permutation of 0..n-1 chosen by the key: a swap-or-not shuffle.

    In each round an index x has a partner, K - x modulo n, and the two change places or not, by a hash of the larger.
    """

    def swapped(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(1), r, *key), n) - x, n)
        return F.when(F.xxhash64(F.lit(2), r, *key, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), index, swapped)


def _before(column: str) -> Column:
    """The running sum of a column over the sources before; there is one row for each source."""
    return F.coalesce(F.sum(column).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def _drawn(quota: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """One row for each slot: slot, shard and the sid it draws, with a chance of the source's share of all slots."""
    slots = session_of(quota).range(0, total, 1, max(1, -(-total // _TASK_SLOTS))).withColumnRenamed("id", "slot")
    slots = slots.withColumn("shard", F.expr(f"slot div {shard_slots}")).withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "slot"), F.lit(max(1, total))))
    lines = quota.select("sid", _before("slots").alias("low"), (_before("slots") + F.col("slots")).alias("until"))
    return _looked_up(slots, "draw", lines, "low", "until", total).select("slot", "shard", "sid")


def _slots(quota: DataFrame, shard_slots: int, seed: int, kept) -> DataFrame:
    """One row for each slot: shard, slot, sid, k, block. kept stores a table; what comes to the driver are two sums."""
    quota = kept(quota, "quota")
    total = quota.agg(F.sum("slots")).first()[0] or 0
    drawn = _drawn(quota, total, shard_slots, seed)
    counts = drawn.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept(counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long"))), "drawn")
    # What each source was drawn too often, and too seldom.
    table = quota.join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    table = table.withColumn("over", F.greatest(F.col("n") - F.col("slots"), F.lit(0))).withColumn("lack", F.greatest(F.col("slots") - F.col("n"), F.lit(0)))
    table = kept(table.select("sid", "blocks", "slots", "n", "lack", _before("over").alias("over_before"), _before("lack").alias("lack_before")), "totals")
    moves = table.agg(F.sum("lack")).first()[0] or 0
    place = F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1
    own = drawn.withColumn("place", place).join(counts.drop("n"), ["sid", "shard"]).withColumn("k", F.col("ahead") + F.col("place"))
    own = own.select("slot", "shard", "sid", "k").join(table.select("sid", "blocks", "slots", "over_before"), "sid")
    stay = own.where(F.col("k") < F.col("slots")).select("slot", "shard", "sid", "blocks", "k")
    moved = own.where(F.col("k") >= F.col("slots")).select("slot", "shard", (F.col("over_before") + F.col("k") - F.col("slots")).alias("move"))
    lines = table.select("sid", "blocks", "n", F.col("lack_before").alias("low"), (F.col("lack_before") + F.col("lack")).alias("until"))
    moved = _looked_up(moved, "move", lines, "low", "until", moves).select("slot", "shard", "sid", "blocks", (F.col("n") + F.col("move") - F.col("low")).alias("k"))
    every = stay.unionByName(moved)
    block = permuted(F.expr("k % blocks"), F.col("blocks"), F.lit(seed), F.col("sid"), F.expr("k div blocks"))
    return every.select("shard", "slot", "sid", "k", block.alias("block"))


class Mix:
    """A mix of documents: ``targets``, ``slots`` (shard and block of each slot), ``pieces`` and ``taken``.

    Sizes count words of whole texts, however long. A null text has size 0; a null source is a source of its
    own, ordered last; a null id is an id like others. Documents of size 0, and all documents of a source
    without words, are taken 0 times. Repeated rows are documents of their own. Reruns over the same
    rows give the same mix, however they are dealt; ``seed`` gives another. An empty table gives an empty
    mix. Columns besides id, text and source are not read.
    """

    def __init__(self, df: DataFrame, id_col="doc_id", text_col="text", source_col="source", block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, most=MOST, weights=WEIGHTS, seed=11):
        docs = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("salt"))
        self.docs = stored(docs, "sizes")
        self.block_words = block_words
        self.targets = stored(source_targets(self.docs, weights, most), "targets")
        self.placed = _placed(self.docs, self.targets, self.docs.count())
        self.slots = _slots(_quota(self.targets, block_words, most), shard_slots, seed, stored)

    def pieces(self) -> DataFrame:
        """Each document's share of each block it lies in (one row with nulls if it has no words), how often the block is taken, and for which shards."""
        w = self.block_words
        span = F.expr(f"CASE WHEN size > 0 THEN sequence(position div {w}, (position + size - 1) div {w}) END")
        rows = self.placed.withColumn("block", F.explode_outer(span))
        first = F.greatest(F.col("position"), F.col("block") * w) - F.col("position")
        until = F.least(F.col("position") + F.col("size"), (F.col("block") + 1) * w) - F.col("position")
        rows = rows.withColumn("first", first).withColumn("words", until - first)
        # A block is in as many slots as passes are begun at most. The optimizer must not take the slots to be few and broadcast them.
        times = self.slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"), F.collect_list("shard").alias("shards")).hint("merge")
        return rows.join(times, ["sid", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))

    def taken(self) -> DataFrame:
        """One row for each document: id, size, source_size, target, taken, shards (those its words go to, ascending)."""
        words = F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0).cast("long")))
        shards = F.array_sort(F.array_distinct(F.flatten(F.collect_list("shards"))))
        keys = ["sid", "chunk", "number", "id", "size", "source_size", "target"]
        return self.pieces().groupBy(*keys).agg(words.alias("taken"), shards.alias("shards")).select("id", "size", "source_size", "target", "taken", "shards")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """id, size, source_size, target (the source's), taken (words the mix takes, repeats counted) and shards (output shards they go to) for each row of df.

    Nulls, long texts, repeated rows and empty tables as in ``Mix``; a document of which nothing is taken has no shards.
    """
    return Mix(df, id_col, text_col, source_col, **options).taken().withColumnRenamed("id", id_col)


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", count_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as rows of df: a document once for each pass that takes any of its blocks, with the words taken.

    A text taken whole is unchanged; otherwise its taken words stand in order, each with the white
    space after it. count_col, if there, is set to the new length. Documents without words (null, empty
    or blank texts) are never taken. Rows equal in id and text count as one document; a null id is an id
    like others. An empty table gives no rows. Columns of any name are carried along.
    """
    mix = Mix(df, id_col, text_col, source_col, **options)
    part = F.struct("first", "words", "times")
    takes = mix.pieces().where(F.col("words").isNotNull()).groupBy("sid", "chunk", "number", "id", "size", "salt").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("times").alias("turns"), F.min("times").alias("least"))
    p = fresh_prefix(df)
    takes = takes.where(F.col("turns") > 0).select(
        F.col("id").alias(f"{p}id"), F.col("salt").alias(f"{p}salt"), F.col("parts").alias(f"{p}parts"), F.col("least").alias(f"{p}least"), F.explode(F.expr("sequence(1L, turns)")).alias(f"{p}turn")
    ).dropDuplicates([f"{p}id", f"{p}salt", f"{p}turn"])
    rows = df.withColumn(f"{p}key", F.xxhash64(text_col)).join(takes, F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}key") == F.col(f"{p}salt")))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"(^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    whole = F.col(f"{p}least") >= F.col(f"{p}turn")
    chosen = F.expr(f"concat_ws('', flatten(transform(filter({p}parts, x -> x.times >= {p}turn), x -> slice({p}words, int(x.first + 1), int(x.words)))))")
    out = rows.withColumn(f"{p}words", F.when(~whole, words)).withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(chosen))
    if count_col and count_col in df.columns:
        out = out.withColumn(count_col, F.length(text_col).cast(df.schema[count_col].dataType))
    return out.select(*df.columns)
