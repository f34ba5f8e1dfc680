"""Merkle manifest of a dataset by time-forward processing.

Each row is a leaf; each source is a ternary tree of its leaves by id, and the sources'
subroots are a tree of their own.  Nodes are labelled (level, index), children before
parents.  A node sends its digest to its parent's label, and a priority queue ordered by
label hands each node the digests of its children.  A second sweep in reversed order sends
each node's proof suffix (the siblings from its level up) to its children, down to leaves.

The queue has two tiers.  Inside a block of :data:`WIDTH` neighbouring nodes it is a heap
in one task; messages between blocks are rows that Spark's sorted shuffle delivers, spilling
to disk as it needs to: one digest up and one suffix down for each block.  A task holds one
block, so a source with any share of the rows is many tasks' work, and texts are read once.

Defined results: a null of any column is hashed as ``-``; rows without an id stand first in
their source; rows with one id follow each other by leaf; repeated rows are leaves of
their own; a row without source belongs to the source that stands first; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.ordered import batches_of, numbered, runs_of
from tessera.llm.textops import stored

#: Children of a node, levels of a block and its leaves.
ARITY, HEIGHT = 3, 6
WIDTH = ARITY**HEIGHT

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# --------------------------------------------------------------------------- digests of a block


def digest_of(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def forward(digests: list[str], height: int) -> list[list[str]]:
    """Digests of all levels of a block, the given ones first.

    The queue holds (label of the receiver, sender, digest); the receiver with the least
    label takes what its children sent and sends its own digest on.
    """
    levels = [digests, *([] for _ in range(height))]
    queue = [((1, i // ARITY), i, d) for i, d in enumerate(digests)] if height else []
    while queue:
        label = level, index = queue[0][0]
        children = []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        own = digest_of(*children)
        levels[level].append(own)
        if level < height:
            heapq.heappush(queue, ((level + 1, index // ARITY), index, own))
    return levels


#: A proof suffix: digests left and right of the node, and the suffix of its parent.
Suffix = tuple[str, str, "Suffix"] | None


def backward(levels: list[list[str]], above: Suffix) -> Iterator[tuple[int, Suffix]]:
    """Each leaf of the block with its suffix, by the reversed sweep from the block's top."""
    queue = [(1 - len(levels), 0, above)]
    while queue:
        level, index, own = heapq.heappop(queue)
        if level == 0:
            yield -index, own
            continue
        first = -index * ARITY
        run = levels[-level - 1][first : first + ARITY]
        for i in range(len(run)):
            heapq.heappush(queue, (level + 1, -(first + i), ("".join(run[:i]), "".join(run[i + 1 :]), own)))


def steps_of(suffix: Suffix) -> Iterator[tuple[str, str]]:
    while suffix is not None:
        left, right, suffix = suffix
        yield left, right


def proof_digest(suffix: Suffix) -> str:
    return digest_of(*(s for step in steps_of(suffix) for s in step))


def folded(leaf: str, suffix: Suffix) -> str:
    """The root that follows from a leaf and its siblings."""
    for left, right in steps_of(suffix):
        leaf = digest_of(left, leaf, right)
    return leaf


def suffix_from(lefts: list[str], rights: list[str]) -> Suffix:
    own: Suffix = None
    for left, right in zip(reversed(lefts), reversed(rights), strict=True):
        own = (left, right, own)
    return own


# --------------------------------------------------------------------------- leaves


def _field(value: Column) -> Column:
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(text if name == "text" else F.col(name)) for name in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, digest and the digest after tampering, if that changes the row; map-only.

    Tampering deletes the line feeds of texts whose id has an even CRC-32.  ``tree`` is the
    source in a form that has no null and keeps its order, a null first.
    """
    text = F.col("text")
    touched = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & text.contains("\n")
    tree = F.coalesce(F.concat(F.lit("."), F.col("source")), F.lit("-"))
    return docs.select(
        "doc_id",
        tree.alias("tree"),
        leaf_digest(text).alias("digest"),
        F.when(touched, leaf_digest(F.translate(text, "\n", ""))).alias("tampered"),
    )


# --------------------------------------------------------------------------- sweeps over blocks


def _blocked(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes with their block, in order; a block is one task's."""
    block = F.floor(F.col("at") / WIDTH)
    rows = nodes.select("tree", block.alias("block"), "at", "digest", *more)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _levels(block: int, digests: list[str]) -> list[list[str]]:
    """A tree's first block may be all of it; any other has as many levels as a full one."""
    return forward(digests, HEIGHT if block else height_of(len(digests)))


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def tops():
        for (tree, block), rows in runs_of(batches, 2):
            yield tree, block, _levels(block, [r[3] for r in rows])[-1][0]

    yield from batches_of(tops(), pa.schema([("tree", pa.string()), ("at", pa.int64()), ("digest", pa.string())]))


def sweep_up(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Nodes of each round: those given, the tops of their blocks, ..., one for each tree.

    ``most`` is the size of the largest tree.
    """
    rounds = [nodes]
    while len(rounds) == 1 or most > 1:
        rounds.append(stored(_blocked(rounds[-1]).mapInArrow(_up, "tree string, at long, digest string"), "tops"))
        most = -(-most // WIDTH)
    return rounds


_MESSAGE = pa.schema(
    [
        ("tree", pa.string()), ("block", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())),
        ("subroot", pa.string()), ("root", pa.string()),
    ]
)
_MESSAGE_DDL = "tree string, block long, lefts array<string>, rights array<string>, subroot string, root string"


def _delivered(nodes: DataFrame, messages: DataFrame, *more: str) -> DataFrame:
    """Rows of each block, the message to its top before its nodes."""
    block = F.floor(F.col("at") / WIDTH)
    rows = nodes.select("tree", block.alias("block"), "at", "digest", *more)
    told = messages.withColumn("at", F.lit(-1).cast("long"))
    both = told.unionByName(rows, allowMissingColumns=True)
    ordered = both.select("tree", "block", "at", "lefts", "rights", "subroot", "root", "digest", *more)
    return ordered.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _blocks_down(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple, Suffix]]:
    """Each node's row, the message of its block, and the node's suffix."""
    for (_, block), rows in runs_of(batches, 2):
        message, nodes = rows[0], rows[1:]
        levels = _levels(block, [r[7] for r in nodes])
        for i, suffix in backward(levels, suffix_from(message[3], message[4])):
            yield nodes[i], message, suffix


def _pass_down(named: bool):
    """Messages from nodes to the blocks or trees below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told():
            for node, message, suffix in _blocks_down(batches):
                steps = list(steps_of(suffix))
                below = (node[8], 0) if named else (node[0], node[2])
                yield (*below, [s[0] for s in steps], [s[1] for s in steps], node[7] if named else message[5], message[6])

        yield from batches_of(told(), _MESSAGE, 500)

    return run


def sweep_down(rounds: list[DataFrame], messages: DataFrame, last: int) -> DataFrame:
    """Messages to the blocks of round ``last`` from those to the trees' tops."""
    for nodes in reversed(rounds[last + 1 : -1]):
        messages = stored(_delivered(nodes, messages).mapInArrow(_pass_down(False), _MESSAGE_DDL), "suffixes")
    return messages


_PROOF = pa.schema(
    [
        ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
        ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()),
    ]
)


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for node, message, suffix in _blocks_down(batches):
            leaf, doc_id, tampered = node[7:10]
            root = message[6]
            again = folded(tampered or leaf, suffix)
            yield doc_id, leaf, message[5], root, proof_digest(suffix), again, again == root

    yield from batches_of(rows(), _PROOF)


def _largest(nodes: DataFrame) -> int:
    return nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``folded_root`` is recomputed from the tampered leaf, if there is one, and the
    siblings of the untampered tree; ``verified`` says that it is the root.
    """
    own = stored(leaves(docs), "leaves")
    placed = numbered(own, "tree", [F.asc_nulls_first("doc_id"), F.asc("digest")])
    trees = sweep_up(placed, _largest(own))
    subroots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    sources = numbered(subroots, "tree", [F.asc("name")])
    tops = sweep_up(sources, subroots.count())
    nothing = F.array().cast("array<string>")
    start = tops[-1].select(
        "tree", F.lit(0).cast("long").alias("block"), nothing.alias("lefts"), nothing.alias("rights"),
        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
    )
    told = sweep_down(tops, start, 0)
    told = stored(_delivered(sources, told, "name").mapInArrow(_pass_down(True), _MESSAGE_DDL), "subroots")
    told = sweep_down(trees, told, 0)
    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _delivered(placed, told, "doc_id", "tampered").mapInArrow(_proofs, kinds)
