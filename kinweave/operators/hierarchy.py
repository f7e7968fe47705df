"""Forests from parent-child rows: cycle detection, Euler tours and list ranking.

1. *Peeling.*  Removing the leaves 2^k times leaves exactly the nodes that have a
   descendant 2^k levels below, i.e. the images of the 2^k-th-ancestor map.  Pointer
   doubling therefore peels 2^k layers in its k-th round.  When a round removes
   nothing, only the cycles are left.
2. *Euler tour.*  Every acyclic node gets an entry and an exit element; siblings
   are chained within hash buckets first and bucket by bucket afterwards, so that a
   node with any number of children is never sorted in one task.
3. *List ranking.*  Pointer jumping over the tours gives each element its distance
   to the end of its list and the sum of +1 (entry) and -1 (exit) up to there, from
   which entry and exit positions and depths follow.  A list of length L takes part
   in log2(L) rounds only, so small trees leave the loop early.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.operators.joins import counted_join
from kinweave.operators.runtime import Scratch

#: Sizes of the blocks that intervals are cut into are the powers of RADIX below RADIX ** SIZES.
RADIX, SIZES = 16, 4
#: Tables of rows at rest that are read side by side before they become one.
PIECES = 3
SIBLING_BUCKETS = 256
KEY_BITS = 62
SEEDS = 4


@dataclass
class Forest:
    """``nodes``: node, root, depth, entry, exit, descendants, state (tree, cycle, below_cycle)."""

    nodes: DataFrame
    links: DataFrame


def parent_links(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """Distinct (node, parent) in lower case; every id that occurs is a node.

    Null and blank ids are no ids.  A node with several parents keeps the smallest,
    so that the links form a function; a node that is its own parent is a cycle.
    """
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    pairs = rows.select(clean(rows[node]).alias("node"), clean(rows[parent]).alias("parent"))
    alone = pairs.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"))
    return pairs.filter(F.col("node").isNotNull()).unionByName(alone).groupBy("node").agg(F.min("parent").alias("parent"))


def _with_keys(scratch: Scratch, links: DataFrame) -> tuple[DataFrame, str]:
    """Links with short keys (node_key, parent_key), and the keys' type.

    The keys are 62-bit hashes that are shown to be free of collisions for these
    ids; after a few seeds with collisions the ids themselves serve.
    """
    for seed in range(SEEDS):
        short = lambda c: F.xxhash64(c, F.lit(seed)).bitwiseAND(F.lit((1 << KEY_BITS) - 1))  # noqa: B023, E731
        keyed = scratch.save(links.select("node", "parent", short(F.col("node")).alias("v"), F.when(F.col("parent").isNotNull(), short(F.col("parent"))).alias("p")))
        if keyed.groupBy("v").count().filter("count > 1").isEmpty():
            return keyed, "bigint"
        scratch.drop(keyed)
    return scratch.save(links.select("node", "parent", F.col("node").alias("v"), F.col("parent").alias("p"))), "string"


def _peel(scratch: Scratch, links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Roots of the acyclic nodes (v, root), and the cycles' nodes (v) or None.

    Rows whose pointer reached a root rest; they are seldom written again and never look up
    anything, so a root with any number of children is no hot key.
    """
    top = links.filter("p is null").select("v")
    near = links.filter("p is not null").select("v", F.col("p").alias("a")).join(top.select(F.col("v").alias("a"), F.lit(True).alias("top")), "a", "left")
    moved = scratch.save(near.select("v", "a", F.coalesce("top", F.lit(False)).alias("rests")))
    rest, left = [], None
    while True:
        rest.append(moved.filter("rests").select("v", "a"))
        if len(rest) == PIECES:
            rest = [scratch.save(reduce(DataFrame.unionByName, rest))]
        going = moved.filter("not rests").select("v", "a")
        now = going.select("a").distinct().count()
        done = reduce(DataFrame.unionByName, rest)
        if now in (0, left):
            roots = top.select("v", F.col("v").alias("root")).unionByName(done.select("v", F.col("a").alias("root")))
            return roots, going.select(F.col("a").alias("v")).distinct() if now else None
        left = now
        step = done.select(F.col("v").alias("a"), F.col("a").alias("b"), F.lit(True).alias("rests")).unionByName(going.select(F.col("v").alias("a"), F.col("a").alias("b"), F.lit(False).alias("rests")))
        moved = scratch.save(going.join(step, "a").select("v", F.col("b").alias("a"), "rests"))


def _element(key, side: int, kind: str):
    """The tour's element of a node: side 0 is its entry, 1 its exit."""
    return key * 2 + side if kind == "bigint" else F.concat(key, F.lit("<>"[side]))


def _tour(forest: DataFrame, kind: str) -> DataFrame:
    """Elements (e, next, w) of the Euler tours of (v, p, rounds); ``next`` is null at the end of a tour."""
    kids = forest.filter("p is not null").select("v", "p", F.pmod(F.xxhash64("v", F.lit("bucket")), F.lit(SIBLING_BUCKETS)).cast("int").alias("bucket"))
    within = kids.withColumn("sibling", F.lead("v").over(W.partitionBy("p", "bucket").orderBy("v")))
    chain = (
        kids.groupBy("p", "bucket").agg(F.min("v").alias("first"), F.max("v").alias("last"))
        .withColumn("after", F.lead("first").over(W.partitionBy("p").orderBy("bucket")))
        .withColumn("place", F.row_number().over(W.partitionBy("p").orderBy("bucket")))
    )
    bridge = chain.filter("after is not null").select(F.col("last").alias("v"), "after")
    first = chain.filter("place = 1").select(F.col("p").alias("v"), "first")
    sibling = within.join(bridge, "v", "left").select("v", F.coalesce("sibling", "after").alias("sibling"))
    full = forest.join(sibling, "v", "left").join(first, "v", "left")
    enter = full.select(_element(F.col("v"), 0, kind).alias("e"), F.coalesce(_element(F.col("first"), 0, kind), _element(F.col("v"), 1, kind)).alias("next"), F.lit(1).alias("w"), "rounds")
    leave = full.select(_element(F.col("v"), 1, kind).alias("e"), F.coalesce(_element(F.col("sibling"), 0, kind), _element(F.col("p"), 1, kind)).alias("next"), F.lit(-1).alias("w"), "rounds")
    return enter.unionByName(leave)


def list_rank(scratch: Scratch, elements: DataFrame) -> DataFrame:
    """Rank of every element of linked lists by pointer jumping.

    ``elements``: e, next (null at the end), w, rounds (log2 of the list's length, rounded
    up).  Returns e, to_end (elements after this one), total (sum of w from here on).
    """
    state = scratch.save(elements.select("e", "next", F.lit(1).cast("bigint").alias("hop"), F.col("w").cast("bigint").alias("total"), "rounds"))
    ready, last = [], state.agg(F.max("rounds")).first()[0] or 0
    for turn in range(last + 1):
        ready.append(state.filter(F.col("rounds") <= turn))
        if turn == last:
            break
        going = state.filter(F.col("rounds") > turn)
        ahead = going.select(F.col("e").alias("next"), F.col("next").alias("n2"), F.col("hop").alias("h2"), F.col("total").alias("t2"))
        jumped = going.filter("next is not null").join(ahead, "next").select("e", F.col("n2").alias("next"), (F.col("hop") + F.col("h2")).alias("hop"), (F.col("total") + F.col("t2")).alias("total"), "rounds")
        state = scratch.save(going.filter("next is null").unionByName(jumped))
    result = ready[0]
    for more in ready[1:]:
        result = result.unionByName(more)
    return result.select("e", (F.col("hop") - 1).alias("to_end"), "total")


def forest(rows: DataFrame, node: str, parent: str) -> Forest:
    """Every node's root, depth and Euler interval.

    Result ``nodes``: node, root, depth, entry, exit, descendants, state.  A node on a
    cycle or below one has state ``cycle`` or ``below_cycle``, root '', depth -1 and null
    for the rest.  Descendants of a node are the nodes of its root whose entry lies
    between its entry and exit.  Repeated rows count once; an empty table gives an
    empty result; other columns of the input are not read.
    """
    scratch = Scratch(rows.sparkSession, "forest")
    links, kind = _with_keys(scratch, parent_links(rows, node, parent))
    roots, cycle = _peel(scratch, links)
    names = links.filter("p is null").select(F.col("v").alias("root"), F.col("node").alias("root_name"))
    tops = scratch.save(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")).join(names, "root").withColumn("members", F.col("size")))
    sized = counted_join(roots, tops, "root", "members", how="inner")
    tree = scratch.save(links.join(sized, "v").select("v", "p", "node", "root_name", "size", F.ceil(F.log2(2 * F.col("size") + 1)).cast("int").alias("rounds")))
    ranked = list_rank(scratch, _tour(tree.select("v", "p", "rounds"), kind))
    side = F.col("e") % 2 if kind == "bigint" else F.when(F.col("e").endswith("<"), 0).otherwise(1)
    key = F.shiftright("e", 1) if kind == "bigint" else F.expr("substring(e, 1, length(e) - 1)")
    pairs = ranked.select(key.alias("v"), side.alias("side"), "to_end", "total").groupBy("v").agg(
        F.max(F.when(F.col("side") == 0, F.col("to_end"))).alias("enter_left"),
        F.max(F.when(F.col("side") == 1, F.col("to_end"))).alias("exit_left"),
        F.max(F.when(F.col("side") == 0, -F.col("total"))).alias("depth"),
    )
    length = 2 * F.col("size") - 1
    good = tree.join(pairs, "v").select(
        "node", F.col("root_name").alias("root"), F.col("depth").cast("int").alias("depth"),
        (length - F.col("enter_left")).alias("entry"), (length - F.col("exit_left")).alias("exit"),
        F.expr("(enter_left - exit_left - 1) div 2").alias("descendants"), F.lit("tree").alias("state"),
    )
    if cycle is None:
        return Forest(good, links)
    bad = links.join(roots, "v", "left_anti").join(cycle.withColumn("state", F.lit("cycle")), "v", "left").select(
        "node", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast("bigint").alias("entry"), F.lit(None).cast("bigint").alias("exit"),
        F.lit(None).cast("bigint").alias("descendants"), F.coalesce("state", F.lit("below_cycle")).alias("state"),
    )
    return Forest(good.unionByName(bad), links)


def _runs(a, b):
    """Numbers from a up to but not including b."""
    return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))


def _cut(nodes: DataFrame) -> DataFrame:
    """``nodes`` with one row per aligned block (size, block) that makes up the inside of their interval."""
    df = nodes.filter("exit - entry > 1").withColumns({"_a": F.col("entry") + 1, "_b": F.col("exit")})
    parts = []
    for size in range(SIZES):
        a, b = F.col("_a"), F.col("_b")
        up, down = F.expr(f"(_a + {RADIX - 1}) div {RADIX}"), F.expr(f"_b div {RADIX}")
        ends = _runs(a, b) if size == SIZES - 1 else F.when(up > down, _runs(a, b)).otherwise(F.concat(_runs(a, up * RADIX), _runs(down * RADIX, b)))
        df = df.withColumn(f"_part{size}", F.transform(ends, lambda x: F.struct(F.lit(size).alias("size"), x.alias("block"))))  # noqa: B023
        df = df.withColumns({"_a": F.when(up < down, up).otherwise(F.lit(0)), "_b": F.when(up < down, down).otherwise(F.lit(0))})
        parts.append(f"_part{size}")
    return df.select(*nodes.columns, F.inline(F.concat(*parts)))


def descendants(result: Forest) -> DataFrame:
    """All (node, descendant, distance) pairs of the trees, from the entry-exit intervals; as many rows as the depths add up to.

    ``node_entry`` orders the ancestors of a descendant from the root down.  Nodes on or
    below cycles have none.
    """
    nodes = Scratch(result.nodes.sparkSession, "intervals").save(result.nodes.filter("state = 'tree'").select("node", "root", "depth", "entry", "exit"))
    above = _cut(nodes.select("root", "node", "depth", "entry", "exit")).select("root", "size", "block", "node", F.col("depth").alias("node_depth"), F.col("entry").alias("node_entry"))
    blocks = F.array(*[F.struct(F.lit(k).alias("size"), F.expr(f"entry div {RADIX**k}").alias("block")) for k in range(SIZES)])
    below = nodes.select("root", F.col("node").alias("descendant"), "depth", F.inline(blocks))
    return above.join(below, ["root", "size", "block"]).select("node", "descendant", (F.col("depth") - F.col("node_depth")).alias("distance"), "node_entry")


def paths(result: Forest, separator: str = ">") -> DataFrame:
    """Each node's path of ids from its root (node, root, depth, path); null on and below cycles.

    The ancestors of a node are those whose intervals hold its entry, in the order of their entries.
    """
    above = descendants(result).groupBy(F.col("descendant").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node_entry", "node"))).alias("above"))
    ids = F.concat(F.coalesce(F.transform("above", lambda x: x["node"]), F.array().cast("array<string>")), F.array("node"))
    joined = result.nodes.join(above, "node", "left")
    return joined.select("node", "root", "depth", F.when(F.col("state") == "tree", F.array_join(ids, separator)).alias("path"))
