"""Mixing sources to target weights: exact quotas, dealt to shards by a multivariate-hypergeometric splitting tree.

Only DataFrame and SQL functions run here. A source's documents fall into blocks by a hash, of about `block_words` words at
most, and some for every shard while there are documents enough.
Its quota of words is that many full passes over its blocks, then blocks in a permuted order until the quota is reached;
the block in which that happens gives documents in hash order. The draws of all sources are then split: a tree node holds
how many draws of each source its shards get, its left half takes a multivariate-hypergeometric sample of them, and so on
down to single shards. Sources are taken `FAN` at a time: more of them are first dealt as groups, then within each group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.draws import hypergeometric, let, uniform
from corpusloom.llm.bpe import free_name
from corpusloom.operators.sampling import place
from corpusloom.runtime import stored

WHITE = r"[\x20\x09-\x0D]"
#: Most sources, or groups of them, that a node of the splitting tree holds.
FAN = 256
#: Blocks, or draws, that one task orders.
PART = 4096


def word_count(text: str) -> Column:
    """Number of runs of non-white ASCII-white-space-separated characters; null and empty have none."""
    t = F.col(text)
    edge = lambda c: F.coalesce(F.ascii(c), F.lit(0)).isin(32, 9, 10, 11, 12, 13).cast("int")
    pieces = F.size(F.split(t, WHITE + "+")) - edge(F.left(t, F.lit(1))) - edge(F.right(t, F.lit(1)))
    return F.when(t.isNull() | (t == ""), F.lit(0)).otherwise(pieces).cast("long")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """Add weight, target and place (from 1) to one row per source (source, source_size).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all words; a target stops at `most`
    times its source, and what is over is shared again by weight. A target is then least(most * size, weight * level),
    and the level is found by raising it to (what full sources leave) / (weights of the others) until it settles: each
    round is one sum over the sources, and the level only rises, so it settles. Without rows or words it is 0.
    """
    named = place(sizes, [F.col("source").isNull(), F.col("source")]).withColumn("place", F.col("place") + 1)
    named = named.withColumn("weight", F.pmod(F.col("place") - 1, F.lit(3)) + 1).withColumn("cap", F.col("source_size") * most)
    named = stored(named, "mix-weights")
    total = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total")).first()["total"]
    level = 0.0
    while total:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        left = named.agg(F.sum(F.when(full, F.col("cap"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        raised = (total - (left["held"] or 0)) / left["weights"] if left["weights"] else level
        if raised <= level:
            break
        level = raised
    return named.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))).drop("cap")


def _left(seed: int) -> Column:
    """The left half's quotas of a node (grp, first, k, q, caps): sources in turn draw from what is left of the node."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    half = F.floor(F.col("k") / 2).cast("int")
    start = F.struct(total(F.col("q")).alias("pop"), total(F.slice("caps", F.lit(1), half)).alias("take"), F.array().cast("array<bigint>").alias("left"))

    def step(acc: Column, i: Column) -> Column:
        own = F.get(F.col("q"), i)
        chance = lambda t, salt: uniform(F.lit(seed), "grp", "first", "k", i, t, F.lit(salt))
        drawn = hypergeometric(own, acc["pop"], acc["take"], chance)
        return let(drawn, lambda h: F.struct((acc["pop"] - own).alias("pop"), (acc["take"] - h).alias("take"), F.array_append(acc["left"], h).alias("left")))

    return F.aggregate(F.sequence(F.lit(0), F.size("q") - 1), start, step, lambda acc: acc["left"])


def _deal(nodes: DataFrame, shards: int, seed: int) -> DataFrame:
    """(place, shard, n > 0) from one node a group: (grp, places, q: draws of each place, caps: draws of each shard).

    Each level is a projection of the one before; nodes without draws are dropped. Row sums are the shards' sizes and
    column sums the quotas, exactly.
    """
    nodes = nodes.select("grp", F.lit(0).alias("first"), F.lit(shards).alias("k"), "places", "q", "caps")
    half = F.floor(F.col("k") / 2).cast("int")
    for level in range((shards - 1).bit_length()):
        if level and level % 5 == 0:
            nodes = stored(nodes.repartition("grp", "first"), "mix-nodes")
        nodes = nodes.withColumn("left", F.when(F.col("k") > 1, _left(seed)))
        whole = F.struct("first", "k", "q", "caps")
        left = F.struct(F.col("first"), half.alias("k"), F.col("left").alias("q"), F.slice("caps", F.lit(1), half).alias("caps"))
        right = F.struct((F.col("first") + half).alias("first"), (F.col("k") - half).alias("k"), F.zip_with("q", "left", lambda x, y: x - y).alias("q"), F.slice("caps", half + 1, F.greatest(F.col("k") - half, F.lit(0))).alias("caps"))
        nodes = nodes.select("grp", "places", F.explode(F.when(F.col("k") > 1, F.array(left, right)).otherwise(F.array(whole))).alias("h")).select("grp", "h.first", "h.k", "places", "h.q", "h.caps")
        nodes = nodes.where(F.exists("q", lambda x: x > 0))
    each = nodes.select(F.col("first").alias("shard"), F.explode(F.arrays_zip("places", "q")).alias("x"))
    return each.select(F.col("x.places").alias("place"), "shard", F.col("x.q").alias("n")).where("n > 0")


def split_tree(quotas: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """(place, shard, n > 0): draws of each source in each shard, from quotas (place from 1, draws); shard sizes differ by 1 at most.

    Sources of `FAN` consecutive places make a group; groups are dealt first, as often as there are more than `FAN`,
    and a group's draws in each shard are then the sizes that its own sources fill. No node holds all sources.
    """
    levels, many = [quotas.select(F.col("place").cast("long").alias("place"), "draws")], quotas.agg(F.max("place")).first()[0] or 0
    while many > FAN:
        groups = levels[-1].groupBy(F.floor((F.col("place") - 1) / FAN).cast("long").alias("up")).agg(F.sum("draws").alias("draws"))
        levels.append(groups.select((F.col("up") + 1).alias("place"), "draws"))
        many = (many + FAN - 1) // FAN
    dealt = None
    for depth, level in reversed([*enumerate(levels)]):
        items = F.array_sort(F.collect_list(F.struct("place", "draws")))
        nodes = level.groupBy((F.floor((F.col("place") - 1) / FAN) + 1).cast("long").alias("grp")).agg(items.alias("s"))
        nodes = nodes.select("grp", F.col("s.place").alias("places"), F.col("s.draws").alias("q"))
        if dealt is None:
            total = F.aggregate("q", F.lit(0).cast("long"), lambda x, y: x + y)
            upto = lambda i: F.floor(total * i / shards).cast("long")
            nodes = nodes.withColumn("caps", F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: upto(i) - upto(i - 1)))
        else:
            none = dealt.select("place").distinct().select("place", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).cast("long").alias("n"))
            held = dealt.select("place", "shard", "n").union(none).groupBy(F.col("place").alias("grp"), "shard").agg(F.sum("n").alias("n"))
            held = held.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("held"))
            nodes = nodes.join(held.select("grp", F.col("held.n").alias("caps")), "grp")
        dealt = stored(_deal(nodes, shards, seed + depth), "mix-tree")
    return dealt


@dataclass
class Plan:
    """sources: one row each (source, place, source_size, target, blocks); blocks: (place, block, draws, last, cut)."""

    sources: DataFrame
    blocks: DataFrame
    seed: int


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("mark")), F.col("blocks"))


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("mark"), F.lit("row"))


def _upto(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of `value` before each row of its group, by the hash order[0], then the others; rows.parts tells
    how many tasks share a group: the hash deals its rows to that many stretches, whose sums are added first."""
    spread = rows.withColumn("stretch", F.floor((order[0].cast("double") / float(1 << 64) + 0.5) * F.col("parts")).cast("long")).withColumn("__v", value)
    sums = spread.groupBy(*by, "stretch").agg(F.sum("__v").alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "stretch", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*by, "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = spread.withColumn("__run", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return run.join(starts, [*by, "stretch"]).withColumn(name, F.col("__start") + F.col("__run")).drop("stretch", "__v", "__run", "__start")


def plan(sized: DataFrame, block_words: int = 1 << 18, shards: int | None = None, most: int = 3, tolerance: float = 0.001, seed: int = 7, spread: int = 64) -> Plan:
    """Decide how often each block is drawn and into which shards, from (doc_id, source, size, mark).

    A source has a block for every `block_words` words, and `spread` of them or two a shard at least, unless it has fewer
    documents: so that the tree deals it to all shards, and a pass is many draws.
    A draw is (copy, shard, whole). In the block that meets the quota, in hash order, the documents before the hash
    `last` are taken in the last draw, and those at it give `cut` words. That is all or none of them, whichever comes
    nearer to the quota, if that misses it by `tolerance` of the target at most; else as many words as are missing.
    Windows run over stretches of blocks of a source and over the documents of one block a source.
    """
    spark = sized.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    least = F.least(F.col("documents"), F.lit(max(spread, 2 * shards)).cast("long"))
    sources = targets(sizes, most).withColumn("blocks", F.greatest(F.lit(1).cast("long"), least, F.ceil(F.col("source_size") / block_words))).drop("documents")
    sources = sources.withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * most))
    sources = sources.withColumn("full", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0)).withColumn("left", F.col("quota") - F.col("full") * F.col("source_size"))
    sources = stored(sources, "mix-sources")
    placed = sized.join(sources.select(F.col("source").alias("own"), "place", "blocks", "target"), F.col("source").eqNullSafe(F.col("own"))).withColumn("block", _block(seed))
    blocks = placed.groupBy("place", "block").agg(F.sum("size").alias("words"))
    blocks = stored(blocks.join(sources.select("place", "full", "left", F.ceil(F.col("blocks") / PART).alias("parts")), "place"), "mix-blocks")
    last = blocks.withColumn("order", F.xxhash64(F.lit(seed), "place", "block"))
    last = _upto(last, ["place"], [F.col("order"), F.col("block")], F.col("words"), "begins").where(F.col("begins") < F.col("left"))
    rest = F.when(F.col("begins") + F.col("words") > F.col("left"), F.col("left") - F.col("begins"))
    last = last.select("place", "block", F.col("full").alias("copy"), rest.alias("rest"))
    whole = blocks.where("full > 0").select("place", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("copy"), F.lit(None).cast("long").alias("rest"))
    drawn = stored(last.union(whole), "mix-drawn")
    counted = drawn.groupBy("place").agg(F.count("*").alias("draws"))
    tree = split_tree(counted, shards, seed)
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slots = tree.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    slots = slots.select("place", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("slot"))
    ranked = drawn.join(counted.select("place", F.ceil(F.col("draws") / PART).alias("parts")), "place").withColumn("order", F.xxhash64(F.lit(seed), "place", "copy", "block", F.lit("slot")))
    ranked = _upto(ranked, ["place"], [F.col("order"), F.col("copy"), F.col("block")], F.lit(1).cast("long"), "slot")
    draw = F.struct("copy", "shard", F.col("rest").isNull().alias("whole"))
    dealt = ranked.join(slots, ["place", "slot"]).groupBy("place", "block").agg(F.array_sort(F.collect_list(draw)).alias("draws"))
    dealt = dealt.join(_cut(placed, drawn, tolerance, seed), ["place", "block"], "left")
    return Plan(sources, stored(dealt, "mix-draws"), seed)


def _cut(placed: DataFrame, drawn: DataFrame, tolerance: float, seed: int) -> DataFrame:
    """(place, block, last, cut) of the blocks that meet their source's quota."""
    own = placed.join(drawn.where(F.col("rest").isNotNull()).select("place", "block", "rest"), ["place", "block"]).withColumn("order", _order(seed))
    own = own.groupBy("place", "block", "rest", "target", "order").agg(F.sum("size").alias("size"), F.count("*").alias("n"))  # equal rows share a hash
    upto = Window.partitionBy("place", "block").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("begins", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    first = own.where(F.col("begins") + F.col("size") > F.col("rest")).groupBy("place", "block").agg(F.min_by(F.struct(*own.columns), F.struct("begins", "order")).alias("x")).select("x.*")
    over, under = F.col("begins") + F.col("size") - F.col("rest"), F.col("rest") - F.col("begins")
    near = F.least(over, under) <= F.col("target") * tolerance
    words = F.when(near & (over <= under), F.col("size")).when(near, F.lit(0)).otherwise(under)
    return first.select("place", "block", F.col("order").alias("last"), F.floor(words / F.col("n")).cast("long").alias("cut"))


DRAW = "array<struct<copy:bigint,shard:int,words:bigint,order:bigint>>"


def decide(sized: DataFrame, made: Plan) -> DataFrame:
    """All columns of sized, then source_size, target, taken and draws (copy, shard, words, order) of each row.

    What a row gives depends on its own hash and its block's row of the plan, so documents are neither sorted nor
    gathered and reruns agree; a row without words is drawn with its block and gives none.
    """
    names = sized.columns
    sources = made.sources.select(F.col("source").alias("own"), "place", "source_size", "target", "blocks")
    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("own"))).withColumn("block", _block(made.seed))
    placed = placed.join(made.blocks, ["place", "block"], "left").withColumn("at", _order(made.seed))
    part = F.when(F.col("at") < F.col("last"), F.col("size")).when(F.col("at") == F.col("last"), F.col("cut")).otherwise(F.lit(0).cast("long"))
    words = lambda d: F.when(d["whole"], F.col("size")).otherwise(part)
    draws = F.transform("draws", lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), words(d).alias("words"), F.xxhash64(F.lit(made.seed), d["shard"], d["copy"], "doc_id", "mark").alias("order"), d["whole"].alias("whole")))
    kept = F.filter(draws, lambda d: (d["words"] > 0) | (d["whole"] & (F.col("size") == 0)))
    kept = F.transform(kept, lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), d["words"].alias("words"), d["order"].alias("order")))
    placed = placed.withColumn("draws", F.coalesce(kept, F.expr(f"cast(array() as {DRAW})")))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return placed.select(*names, "source_size", "target", taken.alias("taken"), "draws")


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, mark) of every row; mark is a hash of the text."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(f"`{text_col}`").alias("size"), F.xxhash64(f"`{text_col}`").alias("mark"))


def mixing_decisions(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, source, size, mark, source_size, target, taken, draws.

    Null and empty texts have no words and null is a source like any other, the last. Null ids and repeated ids are
    rows like others; rows equal in id and text share their fate. Words are counted once and stored; an empty table
    gives an empty table. No row gives more than `most` times its size.
    """
    rows = stored(sized(docs, id_col, source_col, text_col), "mix-sizes")
    return decide(rows, plan(rows, **options))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed rows themselves, with the columns of docs, plus shard and order: sort by both to read the mix.

    Every drawn copy of a document is a row. A document is cut, to its leading words, only where whole ones would miss
    the target of a small source by more than `tolerance`. Rows are dealt to their shards and put in their order there.
    Nulls, empty texts and repeated rows are treated as in mixing_decisions().
    """
    made = plan(stored(sized(docs, id_col, source_col, text_col), "mix-sizes"), **options)
    inner = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("whole_text"))
    inner = inner.withColumn("size", word_count("whole_text")).withColumn("mark", F.xxhash64("whole_text")).drop("whole_text")
    drawn = decide(inner, made).select("doc", "size", F.explode("draws").alias("d"))
    shard, order = free_name(docs, "shard"), free_name(docs, "order")
    text = F.col("doc")[text_col]
    pieces = F.split(text, rf"(?<={WHITE})(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(rf"^{WHITE}"), 1).otherwise(0)
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("d.words").cast("int") + lead), "")
    columns = [F.when(F.col("d.words") < F.col("size"), cut).otherwise(text).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns]
    rows = drawn.select(*columns, F.col("d.shard").alias(shard), F.col("d.order").alias(order))
    return rows.repartition(shard).sortWithinPartitions(shard, order)
