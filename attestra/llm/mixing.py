"""Mixing sources to target weights by a multivariate hypergeometric splitting tree, in Spark's own expressions only.

Every source's documents are dealt by hash into blocks. A source's target fixes how many passes
over its blocks the mix makes, and up to which word of the last pass. The (source, pass, block)
tickets are then split among output shards: at each node of a binary tree the two halves get
exact, hypergeometrically drawn numbers of every source's tickets. A shard takes disjoint runs of
each source's permuted tickets, and its documents are ordered by a hash. What a document is taken
is the sum of its copies in the shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, table, written
from .quality_rules import words

WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
REPEATS = 3
#: Blocks of a source, and sub-blocks of the one block that is taken in part. Plans have so many rows for each source, whatever the corpus.
BLOCKS = 1024
#: Output shards: two to this power.
TREE_DEPTH = 4
SEED = 42
#: Sources, or groups of sources, whose tickets one row draws in turn; more sources make more levels of groups.
WIDTH = 256


def ranked(df: DataFrame, order: Column) -> DataFrame:
    """df with rank, from 0 in that order: sorted ranges are numbered each on its own, and start after the sizes of those before."""
    sorted_ = written(df.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    sizes = sorted_.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("range", before.alias("before"))  # one row for each partition of a shuffle
    return sorted_.join(starts, "range").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1).drop("range", "before")


def common_level(sources: DataFrame) -> float:
    """The level at which min(cap, level * weight) sums to all words: sources that stop give their excess to the others, until none more stops."""
    level = 0.0
    while True:
        stops = F.col("cap") <= level * F.col("weight")
        zero = F.lit(0)
        total, held, rest = sources.agg(F.sum("source_size"), F.sum(F.when(stops, F.col("cap")).otherwise(zero)), F.sum(F.when(stops, zero).otherwise(F.col("weight")))).first()
        if not rest or (total - held) / rest <= level:
            return level
        level = (total - held) / rest


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """k, source, source_size, target of each source of sizes (k, source, size).

    Sources by code point, null last, weigh `weights` in turn. A target is the weight times a common
    level, or `repeats` times the source's size where that is less. Only sums reach the driver.
    """
    by_source = sizes.groupBy("k").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(ranked(by_source, F.col("source").asc_nulls_last()).withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size")))
    return sources.select("k", "source", "source_size", F.least(F.col("cap").cast("double"), common_level(sources) * F.col("weight")).alias("target"))


def _drawn(of: str, marked: str, taken: str, chance: str) -> str:
    """SQL of a hypergeometric draw: how many of `marked` tickets are among `taken` of all `of` tickets, by inversion at `chance`.

    Weights follow from their neighbours' and are summed over twelve standard deviations about the
    mean, beyond which lies less than a double can tell from nothing.
    """
    mean = f"(1D * {taken} * {marked} / {of})"
    reach = f"12 * sqrt({mean} * (1 - 1D * {marked} / {of}) * ({of} - {taken}) / ({of} - 1))"
    low = f"greatest(0L, {taken} - ({of} - {marked}), cast(floor({mean} - {reach}) as bigint) - 1)"
    high = f"least({marked}, {taken}, cast(ceil({mean} + {reach}) as bigint) + 1)"
    following = f"w.w * (1D * ({marked} - v) * ({taken} - v)) / (1D * (v + 1) * ({of} - {marked} - {taken} + v + 1))"
    total = f"aggregate(sequence(r.low, r.high), named_struct('w', 1e-200D, 's', 0D), (w, v) -> named_struct('w', {following}, 's', w.s + w.w), w -> w.s)"
    found = f"aggregate(sequence(r.low, r.high), named_struct('w', 1e-200D, 's', 0D, 'at', r.low), (w, v) -> named_struct('w', {following}, 's', w.s + w.w, 'at', if(w.s < t, v, w.at)), w -> w.at)"
    draw = f"transform(array(named_struct('low', {low}, 'high', {high})), r -> transform(array({chance} * {total}), t -> {found})[0])[0]"
    return f"case when {marked} = 0 or {taken} = 0 then 0L when {marked} = {of} then {taken} else {draw} end"


def _halves(quotas: DataFrame, level: int, seed: int, groups: int) -> DataFrame:
    """node, k, n, x: of each node's tickets (node, k, n), those that its left half gets. Groups of sources draw before the sources in them."""
    of = lambda j: F.col("k") if j == groups else F.pmod(F.xxhash64("k"), F.lit(WIDTH**j)).cast("string")
    given = None
    for j in range(groups):
        parts = quotas.groupBy("node", of(j).alias("g"), of(j + 1).alias("c")).agg(F.sum("n").alias("n"))
        rows = parts.groupBy("node", "g").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("q"), F.sum("n").alias("total"))
        rows = rows.withColumn("d", F.expr("total div 2")) if given is None else rows.join(given, ["node", "g"])
        chance = f"(pmod(xxhash64({seed}, {level}, node, c.c), 9007199254740992L) / 9007199254740992D)"
        step = f"transform(array({_drawn('s.rest', 'c.n', 's.d', chance)}), x -> named_struct('rest', s.rest - c.n, 'd', s.d - x, 'x', array_append(s.x, x)))[0]"
        x = F.expr(f"aggregate(q, named_struct('rest', total, 'd', d, 'x', cast(array() as array<bigint>)), (s, c) -> {step}, s -> s.x)")
        drawn = rows.withColumn("x", x).select("node", F.explode(F.expr("transform(q, (c, i) -> named_struct('c', c.c, 'n', c.n, 'x', x[i]))")).alias("z"))
        given = drawn.select("node", F.col("z.c").alias("g"), F.col("z.x").alias("d"), F.col("z.n").alias("n"))
        if j < groups - 1:
            given = written(given.drop("n"))
    return given.select("node", F.col("g").alias("k"), "n", F.col("d").alias("x"))


def split_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """shard, k, n: the tickets of every source (quotas has k and n), dealt exactly among 2**depth shards.

    A node's left half gets half of its tickets; how many of each source, is drawn from the
    multivariate hypergeometric distribution: source by source, from what remains. Where there are
    more than WIDTH sources, groups of them draw first and the sources of a group share its draw, so
    no row holds more than some WIDTH of either. Chance comes from a hash, so a rerun agrees.
    """
    groups = max(1, math.ceil(math.log(max(quotas.count(), 1), WIDTH)))
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "k", F.col("n").cast("long").alias("n"))
    for level in range(depth):
        halves = _halves(nodes, level, seed, groups)
        sides = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("x").alias("n")), F.struct((2 * F.col("node") + 1).alias("node"), (F.col("n") - F.col("x")).alias("n")))
        nodes = halves.select("k", F.explode(sides).alias("z")).select("z.node", "k", "z.n")
        nodes = written(nodes) if groups > 1 else nodes
    return nodes.select(F.col("node").cast("int").alias("shard"), "k", "n")


def _permuted(*cols: str | Column) -> Column:
    return F.xxhash64(F.lit(SEED), *cols)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, depth: int = TREE_DEPTH) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target, taken, copies, text_key (a hash of the text).

    size counts the text's words (null: 0), taken the words that the mix takes, repeats counted;
    copies lists (shard, place, words) of each time that the document is taken: sorting a shard by
    place shuffles it. A source's taken words are its target without the fraction; the last document
    of the last pass may be taken in part.

    A null source is a source, the last one. Sources without words have a target of 0, and so has
    everything in a corpus without words. Repeated rows count and are taken one by one; an empty
    table gives an empty result. Only the named columns are read. Documents are shuffled without
    their texts, by source and block, so that a hot source lies in as many groups as it has blocks.
    Equal rows are counted first and then numbered, and the number is part of what deals them out, so
    that rows which share an id, or have none, spread over all blocks as well.
    """
    named = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    rows = columns_of(docs, id=id_col, source=docs[source_col].cast("string"), text=text_col)
    rows = rows.select("id", "source", named.alias("k"), F.size(words(F.coalesce("text", F.lit("")))).cast("long").alias("size"), F.xxhash64("text").alias("text_key"))
    equal = rows.groupBy("id", "source", "k", "size", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    key = _permuted(F.col("id").cast("string"), F.col("text_key"), F.col("row"))
    sized = written(equal.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).withColumn("key", key).drop("row", "rows"))
    sized = sized.withColumn("block", F.pmod("key", F.lit(BLOCKS)).cast("int")).withColumn("sub", F.pmod(F.call_function("shiftright", F.col("key"), F.lit(20)), F.lit(BLOCKS)).cast("int"))
    targets = source_targets(sized.groupBy("k", "source").agg(F.sum("size").alias("size")), weights, repeats)
    # Passes over the whole source, and words of the last pass.
    passes = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = written(targets.withColumn("passes", passes).withColumn("rest", F.floor("target").cast("long") - F.col("passes") * F.col("source_size")))
    blocks = written(sized.groupBy("k", "block").agg(F.sum("size").alias("words")).join(targets, "k"))
    plan = _cut(blocks, "block", "rest")
    # Tickets: every block once a pass, and once more if the last pass reaches it.
    tickets = plan.select("k", "block", F.explode(F.expr("if(passes + if(got > 0, 1, 0) > 0, sequence(0L, passes + if(got > 0, 0, -1)), cast(array() as array<bigint>))")).alias("pass"))
    tickets = tickets.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(_permuted("k", "block", "pass"), "block", "pass")) - 1)
    dealt = split_tree(tickets.groupBy("k").agg(F.count(F.lit(1)).alias("n")), depth, SEED)
    runs = dealt.withColumn("to", F.sum("n").over(Window.partitionBy("k").orderBy("shard"))).groupBy("k").agg(F.array_sort(F.collect_list("to")).alias("ends"))
    shards = tickets.join(runs, "k").select("k", "block", "pass", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")).groupBy("k", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"))
    plan = written(plan.join(shards, ["k", "block"], "left"))
    each = sized.join(plan.select("k", "block", "source_size", "target", "passes", "got", "words", "shards"), ["k", "block"])
    out = ["id", "text_key", "size", "source_size", "target", "passes", "shards", "key"]
    edge = (F.col("got") > 0) & (F.col("got") < F.col("words"))
    whole = each.where(~edge).select(*out, F.when(F.col("got") > 0, F.col("size")).otherwise(F.lit(0)).cast("long").alias("part"))
    # The one block of a source that is taken in part: its sub-blocks, and then the documents of one of them.
    inner = each.where(edge)
    subs = _cut(inner.groupBy("k", "sub").agg(F.sum("size").alias("words"), F.first("got").alias("rest")), "sub", "rest")
    inner = inner.withColumnRenamed("got", "of_block").withColumnRenamed("words", "block_words").join(subs.drop("rest"), ["k", "sub"])
    inner_edge = (F.col("got") > 0) & (F.col("got") < F.col("words"))
    subs_whole = inner.where(~inner_edge).select(*out, F.when(F.col("got") > 0, F.col("size")).otherwise(F.lit(0)).cast("long").alias("part"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("k").orderBy(_permuted("key", "size"), "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = inner.where(inner_edge).withColumn("before", before).select(*out, F.greatest(F.lit(0), F.least("size", F.col("got") - F.col("before"))).cast("long").alias("part"))
    every = whole.unionByName(subs_whole).unionByName(last)
    numbers = F.expr("if(passes + if(part > 0, 1, 0) > 0, sequence(0, cast(passes as int) + if(part > 0, 0, -1)), cast(array() as array<int>))")
    copies = F.transform(numbers, lambda i: F.struct(F.get("shards", i).alias("shard"), _permuted(F.col("key"), F.get("shards", i), i).alias("place"), F.when(i < F.col("passes"), F.col("size")).otherwise(F.col("part")).alias("words")))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, copy: total + copy["words"])
    return every.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), "text_key").select(id_col, "size", "source_size", "target", taken.alias("taken"), "copies", "text_key")


def _cut(parts: DataFrame, part: str, rest: str) -> DataFrame:
    """Adds got: the words that the first `rest` words of k hold of each part, parts in permuted order. At most BLOCKS rows for each k."""
    order = Window.partitionBy("k").orderBy(_permuted("k", part), part).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(order), F.lit(0))
    return parts.withColumn("got", F.greatest(F.lit(0), F.least(F.col("words"), F.col(rest) - before)))


def mix_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: docs with size, source_size, target, taken and copies (shard, place, words).

    One row for each id and text, texts whole; a document that the mix doesn't take has no copies.
    Rows that repeat an id and a text are one row with the copies of all. Nulls and empty texts are as
    mix says. Columns of docs that have a result's name are left out. Texts are shuffled once, by id.
    """
    results = ("size", "source_size", "target", "taken", "copies")
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col).withColumnsRenamed({id_col: "id", "text_key": "key"})
    sums = [F.first(c).alias(c) for c in results[:3]] + [F.sum("taken").alias("taken"), F.flatten(F.collect_list("copies")).alias("copies")]
    once = written(mixed.groupBy("id", "key").agg(*sums, F.count(F.lit(1)).alias("rows")))
    kept = [c for c in docs.columns if c not in results]
    packed = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("key"), F.struct(*[docs[c] for c in kept]).alias("row"))
    if not once.where("rows > 1").isEmpty():
        packed = packed.groupBy("id", "key").agg(F.first("row").alias("row"))
    same = packed["id"].eqNullSafe(once["id"]) & (packed["key"] == once["key"])
    return packed.join(once, same).select(*[F.col("row")[c].alias(c) for c in kept], *results)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("text_key")
