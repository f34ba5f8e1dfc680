"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

Conversations are rebuilt so that neighbours share openings, and each distinct sequence of
first turns is a node of a trie.  Totals of subtrees come from a centroid decomposition:
each component of the forest is split at its centroid (the deepest node that has more than
half of the component below it), what the component holds below the centroid is added up
once and added to every node on the way from the centroid to the component's top, and the
parts that remain are split again.  A pair of nodes above each other is parted exactly once,
so each node gets its subtree's total, in a number of rounds that grows with the logarithm
of the largest component whatever the trie's shape: a chain of a million turns halves as a
bush does.  Components of at most :data:`LOCAL` nodes finish in one task each.

A node is known by its least member and its depth; the nodes of one least member are a
chain.  Openings are told apart by 128 bits: the exclusive or of one hash for each turn and
its place, so a conversation of any length is hashed in blocks of :data:`BLOCK` turns.

Defined results: rows without conversation are left out; a null turn number stands before
all others; null roles and texts are empty; turns of one number are ordered by the MD5 of
``role length:role text``, and rows that repeat are turns of their own; a conversation may be
rebuilt without turns and is then a member of the root only; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.ordered import batches_of, numbered, runs_of
from tessera.llm.textops import stored

#: Conversations that open like the first of their family, and its turns they may take at most.
FAMILY, OPENING = 20, 4
#: Turns hashed together, nodes a task finishes alone, ids of a piece of a long list.
BLOCK, LOCAL, PIECE = 1024, 256, 4096


# --------------------------------------------------------------------------- rebuilt conversations


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, nth (from 0), key and words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
    )
    return numbered(stored(turns, "turns"), "conv_id", [F.asc_nulls_first("turn"), F.asc("key")], "nth").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns at their new depth (from 1), and each conversation with its length.

    A conversation takes up to three opening turns of the first of its family in place of
    as many of its own; how many follows from its id.
    """
    conv, wanted = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string")) % OPENING).cast("long")
    family = conv - conv % FAMILY
    opening = turns.where((conv % FAMILY == 0) & (F.col("nth") < OPENING - 1)).select(conv.alias("family"), "nth", "key", "words")
    there = opening.groupBy("family").agg(F.count("*").alias("there"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("family", family).withColumn("wanted", wanted)
    taken = F.least("wanted", F.coalesce("there", F.lit(0)))
    convs = convs.join(there, "family", "left").withColumn("taken", taken)
    given = convs.where("taken > 0").join(opening, "family").where("nth < taken")
    own = turns.where(F.col("nth") >= wanted).join(convs.select("conv_id", "taken"), "conv_id")
    rows = [
        given.select("conv_id", (F.col("nth") + 1).alias("depth"), "key", "words"),
        own.select("conv_id", (F.col("taken") + F.col("nth") - wanted + 1).alias("depth"), "key", "words"),
    ]
    length = F.col("taken") + F.greatest(F.col("n") - F.col("wanted"), F.lit(0))
    return reduce(DataFrame.unionByName, rows), convs.select("conv_id", length.alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, words and the two halves a, b of the hash of all turns up to there."""
    block = F.floor((F.col("depth") - 1) / BLOCK)
    mixed = turns.withColumn("block", block).withColumns({f"_{c}": F.xxhash64(F.lit(c), "key", "depth") for c in "ab"})
    line = Window.partitionBy("conv_id", "block").orderBy("depth")
    inside = mixed.withColumns({c: F.bit_xor(f"_{c}").over(line) for c in "ab"})
    blocks = mixed.groupBy("conv_id", "block").agg(*[F.bit_xor(f"_{c}").alias(f"_{c}") for c in "ab"])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("conv_id", "block", *[F.bit_xor(f"_{c}").over(earlier).alias(f"before_{c}") for c in "ab"]).where("block > 0")
    whole = {c: F.col(c).bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0))) for c in "ab"}
    return inside.join(before, ["conv_id", "block"], "left").withColumns(whole).select("conv_id", "depth", "words", "a", "b")


# --------------------------------------------------------------------------- centroids of large components


def split_large(live: DataFrame, passes: DataFrame, limit: int = LOCAL) -> tuple[list[DataFrame], list[DataFrame]]:
    """Splits components of more than ``limit`` nodes at their centroids until none is left.

    ``live`` has a node (node, depth) with its parent's ``up``, its subtree's ``size``, what
    it adds (``saved``, ``leaves``) and its component, named by the top node (top, top_depth).
    ``passes`` says for each conversation and depth which node it passes and which it passes
    ``next``.  Returns the small components, and totals to be added to nodes.
    """
    component, small, added = ["top", "top_depth"], [], []
    while True:
        large = live.groupBy(*component).agg(F.max("size").alias("total")).where(F.col("total") > limit)
        large = stored(large, "components")
        if not large.head(1):
            return [*small, live], added
        small.append(live.join(large, component, "left_anti"))
        rows = live.join(large, component)
        heavy = 2 * F.col("size") > F.col("total")
        deepest = F.max(F.struct("depth", "node", "size")).alias("c")
        cut = rows.where(heavy).groupBy(*component).agg(deepest)
        cut = stored(cut.select(*component, F.col("c.node").alias("c_node"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size")), "centroids")
        through = passes.join(
            cut.select(*component, F.col("c_node").alias("passed"), F.col("c_depth").alias("depth")), ["passed", "depth"]
        ).select(*component, F.col("conv_id").alias("node"), F.lit(True).alias("through"), "next")
        below = F.coalesce("through", F.lit(False)) & (F.col("depth") > F.col("c_depth"))
        centre = (F.col("depth") == F.col("c_depth")) & (F.col("node") == F.col("c_node"))
        split = rows.join(cut, component).join(through, [*component, "node"], "left")
        split = stored(split.withColumns({"below": below, "centre": centre, "heavy": heavy}), "split")
        held = split.where("below or centre").groupBy(*component).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        added.append(split.where("heavy").select(*component, "node", "depth").join(held, component).select("node", "depth", "saved", "leaves"))
        live = split.where("not centre").select(
            F.when(F.col("below"), F.col("next")).otherwise(F.col("top")).alias("top"),
            F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            "node", "depth", "up",
            (F.col("size") - F.when(F.col("heavy") & ~F.col("below"), F.col("c_size")).otherwise(0)).alias("size"),
            "saved", "leaves",
        )


# --------------------------------------------------------------------------- centroids of small components


def subtree_totals(parent: list[int], values: list[tuple[int, int]]) -> list[list[int]]:
    """Totals of all subtrees of one component by centroid decomposition.

    Nodes are numbered so that a parent (-1 for the top) stands before its children.
    """
    out = [[0, 0] for _ in parent]
    whole = [(list(range(len(parent))), -1)]
    part_of = [0] * len(parent)  # which remaining component a node is in
    names = 1
    while whole:
        nodes, name = whole.pop()
        size = dict.fromkeys(nodes, 1)
        for v in reversed(nodes[1:]):
            size[parent[v]] += size[v]
        way = [v for v in nodes if 2 * size[v] > len(nodes)]  # from the top to the centroid
        centre = way[-1]
        below, parts = {centre: None}, {}
        totals = list(values[centre])
        for v in nodes:
            up = parent[v]
            if v == centre or up not in below:
                continue
            below[v] = v if up == centre else below[up]
            totals[0] += values[v][0]
            totals[1] += values[v][1]
            parts.setdefault(below[v], []).append(v)
        for v in way:
            out[v][0] += totals[0]
            out[v][1] += totals[1]
        whole.extend((own, names) for own in parts.values())
        if len(way) > 1:
            whole.append(([v for v in nodes if v not in below], names))
    return out


_TOTALS = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("saved", pa.int64()), ("leaves", pa.int64())])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (top, top_depth, depth, node, up, saved, leaves), sorted."""

    def totals():
        for _, rows in runs_of(batches, 2):
            at = {(r[3], r[2]): i for i, r in enumerate(rows)}
            parent = [at.get((r[4], r[2] - 1), -1) for r in rows]
            found = subtree_totals(parent, [(r[5], r[6]) for r in rows])
            for r, (saved, leaves) in zip(rows, found, strict=True):
                yield r[3], r[2], saved, leaves

    yield from batches_of(totals(), _TOTALS)


def rolled_up(nodes: DataFrame, passes: DataFrame, limit: int = LOCAL) -> DataFrame:
    """(node, depth) with ``saved`` and ``leaves`` of the whole subtree."""
    small, added = split_large(nodes, passes, limit)
    columns = ["top", "top_depth", "depth", "node", "up", "saved", "leaves"]
    rest = reduce(DataFrame.unionByName, [s.select(*columns) for s in small])
    alone = rest.repartition("top", "top_depth").sortWithinPartitions("top", "top_depth", "depth", "node")
    finished = alone.mapInArrow(_finish, "node long, depth long, saved long, leaves long")
    every = reduce(DataFrame.unionByName, [finished, *added])
    return every.groupBy("node", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


# --------------------------------------------------------------------------- digests of members


_ENDS = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string()), ("digest", pa.string())])


def _ends_of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, depth, conv_id): digests of lists inside the range, pieces of others."""

    def piece(key, ids):
        return *key, ids[0], ",".join(map(str, ids)), None

    def found():
        key, ids, is_open = None, [], True  # the first list may have begun in an earlier range
        for batch in batches:
            for node, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, depth) != key:
                    if ids:
                        yield piece(key, ids) if is_open else (*key, ids[0], None, sha256(",".join(map(str, ids)).encode()).hexdigest())
                        is_open = False
                    key, ids = (node, depth), []
                elif len(ids) == PIECE:
                    yield piece(key, ids)
                    ids, is_open = [], True
                ids.append(conv)
        if ids:  # the last one may go on in the next range
            yield piece(key, ids)

    yield from batches_of(found(), _ENDS)


def _joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces (node, depth, first, ids) read one after another: digests of whole lists."""

    def found():
        key, state = None, None
        for batch in batches:
            for node, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (node, depth) != key:
                    if state:
                        yield *key, state.hexdigest()
                    key, state = (node, depth), sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
        if state:
            yield *key, state.hexdigest()

    yield from batches_of(found(), pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("digest", pa.string())]))


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, digest) of the ids that end at a node, in ascending order.

    Ids are sorted into ranges; a list inside one range is hashed there, and of others
    pieces of :data:`PIECE` ids go on, which one task reads in order without holding them.
    """
    own = stored(ends, "ends").repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")
    lists = stored(own.mapInArrow(_ends_of_ranges, "node long, depth long, first long, ids string, digest string"), "lists")
    pieces = lists.where("digest is null").select("node", "depth", "first", "ids")
    pieces = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")
    whole = pieces.mapInArrow(_joined_pieces, "node long, depth long, digest string")
    return lists.where("digest is not null").select("node", "depth", "digest").unionByName(whole)


# --------------------------------------------------------------------------- the trie


def trie(conversations: DataFrame, limit: int = LOCAL) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(ordered_turns(conversations))
    convs = stored(convs, "conversations")
    told = convs.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    root = F.lit(told["least"]).cast("long")
    rows = stored(prefixes(turns), "prefixes")
    named = rows.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    named = stored(named, "nodes")

    below_root = rows.join(named.select("depth", "a", "b", "node"), ["depth", "a", "b"]).select("conv_id", "depth", F.col("node").alias("passed"))
    at_root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("passed"))
    passed = stored(below_root.unionByName(at_root), "passed")
    after = passed.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("passed").alias("next"))
    passes = stored(passed.join(after, ["conv_id", "depth"], "left"), "passes")

    top = convs.limit(1).select(root.alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(told["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    nodes = named.select("node", "depth", "n_convs", "words").unionByName(top)
    before = passed.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("passed").alias("up"))
    nodes = stored(nodes.join(before, ["node", "depth"], "left"), "nodes-up")  # no parent: the root
    children = nodes.where("up is not null").groupBy(F.col("up").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))

    chains = nodes.groupBy(F.col("node").alias("conv_id")).agg(F.min("depth").alias("first"), F.max("depth").alias("last"))
    in_chain = F.col("last") - F.greatest("first", "depth") + 1
    sizes = passed.join(chains, "conv_id").groupBy(F.col("passed").alias("node"), "depth").agg(F.sum(in_chain).alias("size"))

    n_children = F.coalesce("n_children", F.lit(0)).cast("long")
    whole = nodes.join(children, ["node", "depth"], "left").join(sizes, ["node", "depth"]).withColumn("n_children", n_children)
    whole = stored(whole.withColumns({"top": root, "top_depth": F.lit(0).cast("long")}), "trie")
    live = whole.select(
        "top", "top_depth", "node", "depth", "up", "size",
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"),
    )
    totals = rolled_up(live, passes, limit)
    ends = convs.select("conv_id", F.col("length").alias("depth")).join(passed, ["conv_id", "depth"])
    digests = end_digests(ends.select(F.col("passed").alias("node"), "depth", "conv_id"))
    nobody = F.lit(sha256(b"").hexdigest())
    found = whole.join(totals, ["node", "depth"]).join(digests, ["node", "depth"], "left")
    return found.select(
        F.col("node").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", nobody).alias("ends_sha256"),
    )
