"""MinHash near-duplicates by a signature-coordinate inverted join.

A text is its set of distinct word shingles. Equal sets are one class. Each class posts itself
under its coordinate-value pairs. Classes that meet in a list are counted for collisions, over all
coordinates of their signatures, and those above a match threshold are confirmed on the full sets.
Links make components.

Prefix: two classes that agree in at least LEAST coordinates share one of the values that are left
of either when its LEAST - 1 most frequent ones are taken off, so only those are posted; they share
two of them when one more is left. Skip: values that one class alone has can't collide, and a class
with fewer than LEAST other values posts nothing at all.

A posting list first counts its members against its most central one, its pivot, which is linear
however long the list is. Only lists that this leaves in several components go on:

- Set distance obeys the triangle inequality. What is linked with the pivot is within 0.15 of it, so
  anything linked with that is within 0.30. In a long list, members linked with the pivot therefore
  only meet those that come that near it (the ring), and never those that are farther off.
- The others of a long list meet among themselves. Where most of them are far from the pivot, they have
  little in common but this value: they are split by the next one that a pair shares. Where most of
  them are near it, or a sublist stays long, they are compared block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import HOT_ROWS, columns_of, hot_keys, map_batches, sized_join, spread_join, table, written

SHINGLE = 5
#: Coordinates of a signature.
K = 48
#: Chance that two sets as similar as the threshold agree in too few coordinates and are missed.
LOSS = 1e-6
#: Members of a posting list from which it is long; members that one task compares with as many others; members that one task confirms against one pivot.
LONG, BLOCK, MEMBERS = 512, 4096, 200
#: Link where 100 * intersection >= LINK * union.
LINK = 85


def least_agreeing(percent: int, loss: float = LOSS) -> int:
    """The most coordinates that sets of this similarity agree in but for the given chance: a quantile of the binomial distribution."""
    s, total = percent / 100, 0.0
    for t in range(K + 1):
        total += math.comb(K, t) * s**t * (1 - s) ** (K - t)
        if total > loss:
            return max(t, 2)
    return K


_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MUL = _RANDOM.integers(0, 2**64, K, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    n = 1 << bits
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: sums over the bytes of each, by prefix sums, whatever the shingle's length."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _powers(max(16, int(len(joined)).bit_length()))
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * up[: len(joined)], out=sums[1:])
    ends = np.append(np.flatnonzero(joined == 0x20), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    return np.unique(_mixed((sums[last] - sums[starts[:n]]) * down[starts[:n]] + (last - starts[:n]).astype(np.uint64)))


def signature(sets: np.ndarray) -> np.ndarray:
    """For each coordinate, the least hash of the set under it."""
    out = np.empty(K, np.uint64)
    for i, m in enumerate(_MUL):
        x = sets * m
        out[i] = (x ^ (x >> np.uint64(32))).min()
    return out


def linked(a: np.ndarray, b: np.ndarray, link: int = LINK) -> bool:
    if 100 * min(len(a), len(b)) < link * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= link * (len(a) + len(b) - both)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """id, key (of the text), n (shingles), node (a 128-bit print of the set) and its signature."""

    def run(x: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t, size) for t in x["text"]]
        return {"id": x["id"], "key": x["key"], "n": [len(s) for s in sets], "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "sig": [signature(s).view(np.int64) if len(s) else None for s in sets]}

    return map_batches(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, key long, n long, node binary, sig array<long>")


def _beside_least(links: DataFrame) -> DataFrame:
    """links (u, v) with m, the least v of their u. Hubs are dealt out, if there are any."""
    least = written(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    if least.where(F.col("n") > HOT_ROWS).isEmpty():
        return links.join(least.select("u", "m"), "u")
    return spread_join(links, least.select("u", "m"), "u", ["v"], counts=least.select("u", "n"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): root is the least node of its component.

    Large-star and small-star steps in turn: each node's neighbours are joined to its least one,
    until every node has one neighbour that has none. Every step is a minimum by node and a join
    that deals hubs out; each round is written to the shared checkpoint folder.
    """
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionAll(links.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        if ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)").isEmpty():
            break
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_beside_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")))
        # The least neighbour hands the others on, and each node keeps its link with it.
        small = _beside_least(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = written(small.where("u <> v").distinct())
    # Stars now: each node but a root is linked with its root alone.
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _prefixes(nodes: DataFrame, least: int) -> DataFrame:
    """node, n, sig, central, vals, first: each class that posts, with (freq, cv) of its values by rarity: `first` to post under, and one more."""
    each = nodes.select("node", F.posexplode("sig").alias("c", "v")).select("node", F.xxhash64("c", "v").alias("cv"))
    freq = written(each.groupBy("cv").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1"))
    met = spread_join(each, freq, "cv", ["node"], counts=freq.select("cv", F.col("freq").alias("n")))
    shared = met.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("freq", "cv"))).alias("s")).where(F.size("s") >= least)
    first = F.size("s") - (least - 1)
    kept = shared.select("node", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["freq"]).alias("central"), F.slice("s", F.lit(1), first + 1).alias("vals"), first.alias("first"))
    return kept.join(nodes.select("node", "n", F.transform("sig", lambda x: x.bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("sig")), "node")


def _lists(prefixes: DataFrame, *columns: str) -> DataFrame:
    """Every posting: cv, freq and the columns of its class."""
    return prefixes.select(*columns, F.explode(F.slice("vals", F.lit(1), F.col("first"))).alias("p")).select(*columns, "p.cv", "p.freq")


def _counted(prefixes: DataFrame, pivots: DataFrame, near: int, link: int) -> DataFrame:
    """a, b, agree, fits: each class and each pivot b that it meets in a list, how many coordinates collide, and whether their sizes allow a link."""
    least = 2 * link - 100
    small, large = 100 * F.least("n", "bn"), F.greatest("n", "bn")
    met = sized_join(_lists(prefixes, "node", "n"), pivots, "cv", ["node"], "freq").where((F.col("node") != F.col("b")) & (small >= least * large))
    pairs = met.groupBy(F.col("node").alias("a"), "b").agg(F.first(small >= link * large).alias("fits"))
    left = written(pairs.join(prefixes.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a"))
    full = spread_join(left, prefixes.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b", ["a"])
    agree = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda same: same))
    return full.select("a", "b", agree.alias("agree"), "fits").where(F.col("agree") >= near)


def _with_texts(targets: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """targets with the texts of their nodes. Texts are dealt out once, by id, and repeated rows of an id and text count once."""
    keyed = targets.join(nodes.select("node", "id", "key"), "node")
    wanted = keyed.select("id", "key").distinct()
    texts = rows.join(wanted, ["id", "key"], "left_semi").groupBy("id", "key").agg(F.first("text").alias("text"))
    return keyed.join(texts, ["id", "key"]).drop("id", "key")


def _confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, size: int, link: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets. The members of a pivot b are dealt to groups of about MEMBERS, and each group reads them one by one."""
    hot = hot_keys(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b", MEMBERS)
    salts = F.coalesce("salts", F.lit(1))
    members = pairs.join(hot, "b", "left").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), salts).cast("int").alias("part"), F.lit(1).alias("member"))
    heads = pairs.select("b").distinct().join(hot, "b", "left").select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("part"), F.lit(0).alias("member"))
    placed = _with_texts(written(members.unionByName(heads)), nodes, rows).select("b", "part", "member", "node", "text")
    arrow = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for b, member, node, text in zip(*(batch.column(c).to_pylist() for c in ("b", "member", "node", "text"))):
                if not member:
                    head = shingles(text, size)
                elif linked(head, shingles(text, size), link):
                    found.append((node, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], schema=arrow)

    return placed.repartition("b", "part").sortWithinPartitions("b", "part", "member").mapInArrow(run, "a binary, b binary")


def _block_pairs(rows: dict[str, list], link: int, least: int) -> Iterator[tuple[int, int]]:
    """One by one, pairs of one block pair of one list that collide often enough, lie in different components and meet in no other list."""
    cv, last = rows["cv"][0], rows["cv"][0] if rows["next"][0] is None else rows["next"][0]
    sig, n = np.array(rows["sig"]), np.array(rows["n"])
    root, mine = np.array(rows["root"]), np.array(rows["mine"])
    # Values by rarity that come before this list's, apart from those it is named for: a pair that shares one of them meets there.
    before = [frozenset(v[: v.index(last)]) - {cv} for v in rows["vals"]]
    same = rows["bi"][0] == rows["bj"][0]
    low, high = np.flatnonzero(mine == rows["bi"][0]), np.flatnonzero(mine == rows["bj"][0])
    for k, i in enumerate(low.tolist()):
        at = high[k + 1 :] if same else high
        at = at[(root[at] != root[i]) & (100 * np.minimum(n[at], n[i]) >= link * np.maximum(n[at], n[i]))]
        at = at[(sig[at] == sig[i]).sum(1) >= least] if len(at) else at
        yield from ((i, j) for j in at.tolist() if before[i].isdisjoint(before[j]))


def _block_links(rows: dict[str, list], link: int, least: int, size: int) -> list[tuple[bytes, bytes]]:
    """Of those pairs, links by full sets, as far as they join components that no earlier link of the block pair has joined."""
    over: dict[bytes, bytes] = {}
    sets: dict[int, np.ndarray] = {}

    def top(r: bytes) -> bytes:
        while r in over:
            r = over[r]
        return r

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(rows["text"][i], size)
        return sets[i]

    out = []
    for i, j in _block_pairs(rows, link, least):
        a, b = top(rows["root"][i]), top(rows["root"][j])
        if a != b and linked(of(i), of(j), link):
            over[max(a, b)] = min(a, b)
            out.append((rows["node"][i], rows["node"][j]))
    return out


_GROUP = ("cv", "next", "bi", "bj")


def _by_group(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn on the rows ({column: values}) of each block pair of a list, one group at a time; fn returns columns of the schema."""
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, rows_out = None, {}, {f.name: [] for f in arrow}, 0

        def packed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
            for c in out.values():
                c.clear()
            return batch

        for batch in batches:
            x = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            for i, now in enumerate(zip(*(x[c] for c in _GROUP))):
                if now != key:
                    if key is not None and len(held["node"]) > 1:
                        for c, v in fn(held).items():
                            out[c] += v
                        if len(out[arrow.names[0]]) > 1000:
                            yield packed()
                    key, held = now, {c: [] for c in x}
                for c in held:
                    held[c].append(x[c][i])
        if key is not None and len(held["node"]) > 1:
            for c, v in fn(held).items():
                out[c] += v
        yield packed()

    return df.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, kind)


def _in_blocks(df: DataFrame, members: str, next_: Column) -> DataFrame:
    """Rows (cv, node, root) dealt to blocks of BLOCK by the column that counts the list's members, once for each other block."""
    blocks = F.ceil(F.col(members) / BLOCK).cast("int")
    out = df.withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.select("cv", next_.alias("next"), "node", "root", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "mine")


def _open_members(prefixes: DataFrame, pivots: DataFrame, roots: DataFrame, counted: DataFrame, edges: DataFrame) -> DataFrame:
    """cv, next, node, root, bi, bj, mine: who is still to be compared with whom, in lists of several components.

    next is the second value that names a sublist, or null. Blocks of the members that are linked
    with the pivot have negative numbers.
    """
    none = F.lit(None).cast("long")
    placed = prefixes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    posted = _lists(placed, "node", "root")
    several = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("freq"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").drop("lo", "hi")
    rest = written(sized_join(posted, several(posted, "cv"), "cv", ["node"], "freq"))
    zero = F.lit(0)
    short = rest.where(F.col("freq") <= LONG).select("cv", none.alias("next"), "node", "root", zero.alias("bi"), zero.alias("bj"), zero.alias("mine"))
    long = sized_join(rest.where(F.col("freq") > LONG), pivots.where(F.col("freq") > LONG).select("cv", "freq", "b"), "cv", ["node"], "freq")
    told = long.join(counted.select(F.col("a").alias("node"), "b", F.lit(True).alias("near")), ["node", "b"], "left").join(edges.select(F.col("a").alias("node"), "b", F.lit(True).alias("star")), ["node", "b"], "left")
    star, near = F.coalesce("star", F.lit(False)) | (F.col("node") == F.col("b")), F.coalesce("near", F.lit(False))
    told = written(told.select("cv", "freq", "node", "root", F.when(star, "STAR").when(near, "RING").otherwise("FAR").alias("kind")))
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(kind.lower() + "s")
    sizes = told.groupBy("cv").agg(F.first("freq").alias("freq"), count("STAR"), count("RING"), count("FAR")).withColumn("others", F.col("rings") + F.col("fars"))
    told = sized_join(told, sizes, "cv", ["node"], "freq")
    others, splits = told.where("kind <> 'STAR'"), (F.col("others") > BLOCK) & (F.col("fars") > F.col("rings"))
    dense = _in_blocks(others.where(~splits), "others", none)
    # Linked ones and the ring, block by block.
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    hashed = lambda n: F.pmod(F.xxhash64("node"), parts(n)).cast("int")
    of_star = told.where("kind = 'STAR' and rings > 0").withColumn("mine", -1 - hashed("stars")).withColumn("bi", F.explode(F.sequence(zero, parts("rings") - 1))).withColumn("bj", F.col("mine"))
    of_ring = told.where("kind = 'RING'").withColumn("mine", hashed("rings")).withColumn("bi", F.col("mine")).withColumn("bj", F.explode(F.sequence(-parts("stars"), F.lit(-1))))
    across = of_star.select("cv", none.alias("next"), "node", "root", "bi", "bj", "mine").unionByName(of_ring.select("cv", none.alias("next"), "node", "root", "bi", "bj", "mine"))
    # The values after this one in a member's prefix name its sublists.
    at = F.array_position(F.transform("vals", lambda x: x["cv"]), F.col("cv")).cast("int")
    after = F.transform(F.slice("vals", at + 1, F.greatest(F.size("vals") - at, zero)), lambda x: x["cv"])
    split = others.where(splits).select("cv", "node", "root").join(prefixes.select("node", "vals"), "node")
    split = written(split.select("cv", "node", "root", F.explode(after).alias("next")).withColumn("list", F.xxhash64("cv", "next")))
    sizes = several(split, "list").withColumnRenamed("freq", "m")
    apart = spread_join(split, sizes, "list", ["node"], counts=sizes.select("list", F.col("m").alias("n")))
    return short.unionByName(dense).unionByName(across).unionByName(_in_blocks(apart, "m", F.col("next")))


def _rest(members: DataFrame, prefixes: DataFrame, nodes: DataFrame, rows: DataFrame, size: int, link: int, least: int) -> DataFrame:
    """Links (a, b) between different components within a list, block by block.

    First only signatures are dealt out, to find which members of a block pair have any pair to
    confirm. Those get their texts, and are confirmed where they are: pairs never become rows, and a
    block pair returns fewer links than it has members.
    """
    dealt = members.join(prefixes.select("node", "n", "sig", F.transform("vals", lambda x: x["cv"]).alias("vals")), "node")
    schema = "cv long, next long, bi int, bj int, mine int, node binary, root binary, n long, sig array<int>, vals array<long>"

    def having(rows: dict[str, list]) -> dict[str, list]:
        some = sorted({k for pair in _block_pairs(rows, link, least) for k in pair})
        return {c: [v[k] for k in some] for c, v in rows.items()}

    def links(rows: dict[str, list]) -> dict[str, list]:
        found = _block_links(rows, link, least, size)
        return {"a": [a for a, _ in found], "b": [b for _, b in found]}

    candidates = written(_by_group(dealt, having, schema))
    return _by_group(_with_texts(candidates, nodes, rows), links, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, link: int = LINK) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept, text_key (a hash of the text).

    component_id is the smallest id that links reach from the row's text, itself included; kept is
    whether the row has that id. Null and empty texts have no shingles and are linked with nothing.
    A row without an id is kept and has no component, and lends none to others. Rows that repeat an
    id and a text repeat the result; rows that share an id only are told apart by their texts. An
    empty table gives an empty result. Only the named columns are read.

    A link as weak as the threshold is missed with a chance of LOSS, as far as no other link joins
    its components. Signatures, classes and links are written to the shared checkpoint folder between
    steps. Texts are shuffled by id for candidates only.
    """
    least, near = least_agreeing(link), least_agreeing(2 * link - 100)
    rows = columns_of(docs, id=id_col, text=text_col).withColumn("key", F.xxhash64("text"))
    base = written(_signed(rows, size))
    some = base.where("node is not null and id is not null")
    # The row that lends its text to a class is that of the smallest id.
    nodes = some.groupBy("node").agg(F.min(F.struct("id", "key")).alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.select("node", "row.id", "row.key", "n", "sig", "copies"))
    prefixes = written(_prefixes(nodes, least))
    pivots = _lists(prefixes, "node", "n", "central").groupBy("cv").agg(F.first("freq").alias("freq"), F.max(F.struct("central", "node", "n")).alias("p"))
    pivots = written(pivots.select("cv", "freq", F.col("p.node").alias("b"), F.col("p.n").alias("bn")))
    counted = written(_counted(prefixes, pivots, near, link))
    texts = rows.where("id is not null")
    edges = written(_confirmed(counted.where(F.col("fits") & (F.col("agree") >= least)).select("a", "b"), nodes, texts, size, link))
    members = _open_members(prefixes, pivots, components(edges), counted, edges)
    more = written(_rest(members, prefixes, nodes, texts, size, link, least))
    roots = components(edges.unionAll(more))
    grouped = written(nodes.select("node", "id").join(roots, "node"))
    ids = grouped.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_node = spread_join(grouped, ids.drop("n"), "root", ["node"], counts=ids.select("root", "n")).select("node", "component_id")
    named = written(nodes.select("node", "id").join(by_node, "node", "left").select("node", F.coalesce("component_id", "id").alias("component_id")))
    told = base.where("node is not null").select("id", "key", "n", "node")
    out = spread_join(told, named, "node", ["id", "key"], counts=nodes.select("node", F.col("copies").alias("n")), how="left").select("id", "key", "n", "component_id")
    out = out.unionByName(base.where("node is null").select("id", "key", "n", F.col("id").alias("component_id")))
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.col("key").alias("text_key"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with its columns: that of the smallest id. Rows that repeat an id and a text count once.

    Null and empty texts and rows without an id are kept, as near_duplicates says, once for each id
    and text. Columns of any name go along as they are; an empty table gives an empty result.
    """
    verdicts = near_duplicates(docs, id_col=id_col, text_col=text_col).where("kept").select(F.col(id_col).alias("id"), F.col("text_key").alias("key")).distinct()
    packed = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same = packed["id"].eqNullSafe(verdicts["id"]) & (packed["key"] == verdicts["key"])
    one = packed.join(verdicts, same, "left_semi").groupBy("id", "key").agg(F.first("row").alias("row"))
    return one.select(*[one["row"][c].alias(c) for c in docs.columns])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT p.a, p.b FROM both_have p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 85 * (x.n + y.n - p.i)),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.r) AS component_id, w.doc_id = min(reach.r) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY w.doc_id, n.n
"""
