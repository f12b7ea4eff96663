"""Merkle manifest of a table: a digest per row, a tree per group, one root, and a proof for every row.

Time-forward processing: a node's label is (its last leaf, its level), so labels rise from children to parents. A queue
ordered by label delivers child digests to their parent; nodes are made in the order of their labels, when the sweep over
the leaves has passed the last one below. The queue is external: a block of ARITY**HEIGHT leaves is
swept by one task, whose part of the queue holds a few digests per level, and what leaves a block is addressed to its block of the
next round and sorted there by Spark's shuffle. The reversed sweep takes the labels downwards: a
node hands its proof suffix to its children, with their siblings in front, until all leaves have theirs.

A group of most rows is many blocks; a task holds the digests of one block, never a group. The number of
rounds is the logarithm of the largest group to the base of a block's leaves.

Nulls anywhere are values of their own. Leaves with equal order keys stand by digest; equal rows are leaves of their own, next to each
other. An empty table gives no rows. Carried columns may have any names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.columns import col, require
from colwright.llm.ranks import numbered
from colwright.sources.shared import kept

ARITY = 8
HEIGHT = 4  # levels that a task adds to the leaves of a block
PROOF = "array<struct<left:string,right:string>>"
UP = "grp string, pos bigint, n bigint, digest string"


def leaf_digest(*values: Column) -> Column:
    """Hex SHA-256 of the values in a row: `-` for null, else the length in UTF-8 bytes, a colon and the value."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _hash(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _height(n: int, most: int) -> int:
    """Levels above the leaves of a block in a group of n: `most`, or those up to the group's root."""
    height = 0
    while height < most and ARITY**height < n:
        height += 1
    return height


class Sweep:
    """The upward sweep over one block. Nodes come out as (label, labels of the children, their digests)."""

    def __init__(self, leaves: int, height: int, log: list | None = None):
        self.leaves, self.height, self.log = leaves, height, log
        self.queue: list = []  # (parent's label, child's label, digest)
        self.at, self.root = 0, None

    def _deliver(self, label: tuple[int, int], digest: str) -> None:
        last, level = label
        if level == self.height:
            self.root = digest
            return
        width = ARITY ** (level + 1)
        parent = min((last // width + 1) * width, self.leaves) - 1, level + 1
        heapq.heappush(self.queue, (parent, label, digest))

    def add(self, digest: str) -> None:
        """The next leaf; makes every node that has its last leaf now."""
        self._deliver((self.at, 0), digest)
        while self.queue and self.queue[0][0][0] <= self.at:
            label, children, digests = self.queue[0][0], [], []
            while self.queue and self.queue[0][0] == label:
                _, child, d = heapq.heappop(self.queue)
                children.append(child)
                digests.append(d)
            if self.log is not None:
                self.log.append((label, children, digests))
            self._deliver(label, _hash(digests))
        self.at += 1


def _up(height: int):
    """Over rows sorted by group, block and position: one row per block, with its root at the block's place."""
    full = ARITY**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sweep = None, None
        for batch in batches:
            out: list[tuple] = []
            get = [batch.column(i).to_pylist() for i in (batch.schema.get_field_index(c) for c in ("grp", "block", "n", "digest"))]
            for grp, block, n, digest in zip(*get):
                if (grp, block) != here:
                    here, sweep = (grp, block), Sweep(min(full, n - block * full), _height(n, height))
                sweep.add(digest)
                if sweep.at == sweep.leaves:
                    out.append((grp, block, -(-n // full), sweep.root))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["grp", "pos", "n", "digest"])

    return run


def _proofs(digests: list[str], height: int) -> tuple[str, list[tuple | None]]:
    """The block's root and, for each leaf, its steps as (left, right, further steps).

    The reversed sweep: labels downwards, each node with the suffix that its parent has delivered.
    """
    log: list = []
    sweep = Sweep(len(digests), height, log)
    for d in digests:
        sweep.add(d)
    steps: list[tuple | None] = [None] * len(digests)
    queue: list = []  # (label reversed, suffix); a node's suffix is there before its turn
    if log:
        heapq.heappush(queue, ((-log[-1][0][0], -log[-1][0][1]), None))
    while log:
        label, children, below = log.pop()
        _, suffix = heapq.heappop(queue)
        for i, child in enumerate(children):
            step = "".join(below[:i]), "".join(below[i + 1 :]), suffix
            if child[1] == 0:
                steps[child[0]] = step
            else:
                heapq.heappush(queue, ((-child[0], -child[1]), step))
    return sweep.root, steps


def _down(out_schema: pa.Schema, height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(message: dict | None, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            digests = rows.column("digest").to_pylist()
            root, steps = _proofs(digests, _height(rows.column("n")[0].as_py(), height))
            tail = message["proof"] if message else []
            tail_left, tail_right = [s["left"] for s in tail], [s["right"] for s in tail]
            left, right, cuts = [], [], [0]
            for step in steps:
                while step is not None:
                    left.append(step[0])
                    right.append(step[1])
                    step = step[2]
                left += tail_left
                right += tail_right
                cuts.append(len(left))
            pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
            same = [message["subroot"]] * len(digests) if message else digests
            new = {
                "subroot": pa.array(same, pa.string()),
                "root": pa.array([message["root"] if message else root] * len(digests), pa.string()),
                "proof": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs),
            }
            arrays = [new[f.name] if f.name in new else rows.column(f.name).combine_chunks() for f in out_schema]
            return pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=out_schema.names)

        here, message, parts = None, None, []
        for batch in batches:
            keys = list(zip(batch.column(batch.schema.get_field_index("grp")).to_pylist(), batch.column(batch.schema.get_field_index("block")).to_pylist()))
            start = 0
            while start < len(keys):
                stop = start + 1
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if keys[start] != here:
                    if parts:
                        yield finish(message, parts)
                    here, message, parts = keys[start], None, []
                if batch.column(batch.schema.get_field_index("pos"))[start].as_py() < 0:
                    message = batch.slice(start, 1).to_pylist()[0]
                    start += 1
                if start < stop:
                    parts.append(batch.slice(start, stop - start))
                start = stop
        if parts:
            yield finish(message, parts)

    return run


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _climb(nodes: DataFrame, height: int) -> list[tuple[DataFrame, DataFrame]]:
    """Per round the nodes (grp, pos, n, digest, row) and the groups that end in it (grp, digest)."""
    rounds, row = [], nodes.schema["row"].dataType
    while True:
        narrow = nodes.select("grp", F.floor(F.col("pos") / ARITY**height).alias("block"), "pos", "n", "digest")
        raised = kept(_dealt(narrow).mapInArrow(_up(height), UP), "merkle-nodes")
        rounds.append((nodes, raised.filter("n <= 1").select("grp", "digest")))
        rest = raised.filter("n > 1")
        if rest.isEmpty():
            return rounds
        nodes = rest.withColumn("row", F.lit(None).cast(row))


def _descend(rounds: list[tuple[DataFrame, DataFrame]], tops: DataFrame | None, height: int) -> DataFrame:
    """The first round's nodes with subroot, root and proof; `tops` holds those of each group (grp, subroot, root, proof)."""
    found = None
    for number in range(len(rounds) - 1, -1, -1):
        nodes, ends = rounds[number]
        none = [F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"), F.lit(None).cast(PROOF).alias("proof")]
        leaves = nodes.select("grp", F.floor(F.col("pos") / ARITY**height).alias("block"), "pos", "n", "digest", "row", *none)
        empty = [F.lit(-1).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("digest")]
        empty.append(F.lit(None).cast(nodes.schema["row"].dataType).alias("row"))
        if tops is not None:
            ended = ends.select("grp").join(tops, "grp")
            leaves = leaves.unionByName(ended.select("grp", F.lit(0).cast("bigint").alias("block"), *empty, "subroot", "root", "proof"))
        if found is not None:
            leaves = leaves.unionByName(found.select("grp", F.col("pos").alias("block"), *empty, "subroot", "root", "proof"))
        schema = T.StructType([f for f in leaves.schema.fields if f.name not in ("block", "n")])
        found = _dealt(leaves).mapInArrow(_down(_arrow(schema), height), schema)
        if number:
            found = kept(found, "merkle-proofs")
    return found


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def manifest(df: DataFrame, leaf: Column, order: str, group: str, carry: dict[str, Column], height: int = HEIGHT) -> DataFrame:
    """The carried columns with leaf, pos (place in the group), subroot, root and proof.

    Per value of `group`, leaves ascend by `order` (nulls first); groups stand nulls first, then by code point. While a tree has several
    nodes, each ARITY consecutive ones become the digest of their digests; the groups' roots form the last tree. `proof` lists
    the siblings left and right of the path per level, from leaf to root. Carry narrow columns: they are shuffled three times.
    """
    require(df, order, group)
    taken = {c.lower() for c in ("leaf", "pos", "subroot", "root", "proof")} & {c.lower() for c in carry}
    if taken:
        raise ValueError(f"carried columns need other names than {sorted(taken)}")
    key = F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit("-"))  # "-" sorts before "="
    rows = kept(
        df.select(key.alias("grp"), col(order).alias("at"), leaf.alias("digest"), F.struct(*[v.alias(k) for k, v in carry.items()]).alias("row")),
        "merkle-leaves",
    )
    placed = numbered(rows, "grp", [F.col("at").asc_nulls_first(), F.col("digest")], "merkle-order")
    placed = placed.select("grp", "pos", "n", "digest", "row")
    rounds = _climb(placed, height)
    ends = rounds[0][1]
    for _, more in rounds[1:]:
        ends = ends.unionByName(more)
    groups = ends.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest", F.struct(F.col("grp").alias("key")).alias("row"))
    groups = numbered(groups, "grp", [F.col("key")], "merkle-groups").select("grp", "pos", "n", "digest", "row")
    tops = kept(_descend(_climb(groups, height), None, height).select(F.col("row.key").alias("grp"), F.col("digest").alias("subroot"), "root", "proof"), "merkle-roots")
    found = _descend(rounds, tops, height)
    return found.select("row.*", F.col("digest").alias("leaf"), "pos", "subroot", "root", "proof")


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to: that of the manifest if and only if the row is as it was."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
