"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids.

A turn (role, text) has an id of 16 bytes, the head of a digest; a conversation is the bytes of its turns' ids, one
after another, with the UTF-8 length of each text beside it. Conversations are sorted over the whole cluster by these
bytes, then by conv_id: ranges, not groups, so a first turn or a whole conversation that a third of all share fills
several tasks like anything else. A task goes through its range in batches of at most `BATCH` conversations and builds
one adaptive radix tree for each: inner nodes grow from 4 to 16, 48 and 256 places, and runs of bytes without a branch
are kept as a node's prefix. Nodes of the trie are emitted only at byte depths that end a turn.

A batch is a piece of the global order, so a trie node lies in more than one batch only if it is on the path of the
batch's first or last conversation (the batch's edges). All other nodes are finished where they are found. Edge nodes
are added up over batches in three small steps that never look at conversations again: the first batch that holds an
edge node owns it; every other batch corrects what it counted for that node and for the nodes above it, which needs one
number per batch (the depth up to which its first path is owned by an earlier one); then sums per node are exact.
The hash of the conversations that end at an edge node is taken over pieces, one from each batch, in order.

`turn_sequences` makes the bytes, `share_openings` gives conversations another's opening, `prefix_trie` builds nodes.

Nulls and odd input: a null role or text is empty; rows with a null conv_id belong to no conversation and take no part.
A null turn comes first; rows of one conversation with the same turn number are ordered by their turn id, and rows
repeated in full are turns of their own. A conversation without turns is a member of the root only. Texts of any length
count whole; their ids and lengths alone are shuffled. One conversation's ids are held together, 24 bytes a turn. An
empty table gives no nodes. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from skysieve.llm.shared import slices
from skysieve.session import materialise

#: Bytes of a turn's id and of a text's length.
WIDTH, SIZE = 16, 8
#: Conversations and bytes of ids of one tree.
BATCH, BATCH_BYTES = 1 << 15, 1 << 26
NOBODY = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart; the length of the role keeps role and text apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * WIDTH))


def turn_sequences(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Per conversation its turns in order, packed: conv_id, ids (16 bytes a turn), sizes (8 bytes a turn)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted, so a conversation is a run of rows; it may go on in the next batch
        current, ids, sizes = None, [], []
        for batch in batches:
            done: tuple[list, list, list] = ([], [], [])
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "id", "size"))
            for c, i, n in zip(*columns):
                if c != current:
                    if current is not None:
                        _put(done, current, b"".join(ids), np.array(sizes, ">i8").tobytes())
                    current, ids, sizes = c, [], []
                ids.append(i)
                sizes.append(n)
            if done[0]:
                yield _sequences(done)
        if current is not None:
            yield _sequences(([current], [b"".join(ids)], [np.array(sizes, ">i8").tobytes()]))

    said, body = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_id(said, body).alias("id"),
        F.octet_length(body).cast("long").alias("size"),
    )
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "id")
    return placed.mapInArrow(run, "conv_id long, ids binary, sizes binary")


def _put(columns: tuple[list, ...], *values) -> None:
    for column, value in zip(columns, values):
        column.append(value)


def _sequences(columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "ids", "sizes"])


def share_openings(sequences: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation c with its first h turns replaced by the first h of conversation c - c % group.

    h is crc32 of c's decimal digits, modulo `heads`. All of the opening's turns, if it has fewer; none, if there is no
    such conversation.
    """
    sequences = materialise(sequences, "trie-turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    rows = sequences.select("conv_id", "ids", "sizes", (F.col("conv_id") - F.col("conv_id") % group).alias("of"), h.alias("h"))
    opening = sequences.select(F.col("conv_id").alias("of"), F.col("ids").alias("of_ids"), F.col("sizes").alias("of_sizes"))

    def spliced(head: str, own: str, width: int) -> Column:
        first = F.substring(F.coalesce(F.col(head), F.lit(b"")), F.lit(1), F.col("h") * width)
        return F.concat(first, F.substring(F.col(own), F.col("h") * width + 1, F.octet_length(own)))

    return rows.join(opening, "of", "left").select(
        "conv_id", spliced("of_ids", "ids", WIDTH).alias("ids"), spliced("of_sizes", "sizes", SIZE).alias("sizes")
    )


class Node:
    """A node of an adaptive radix tree: a compressed prefix, then up to 256 children by one byte each.

    With 4 or 16 places `keys` holds the children's bytes, sorted like `kids`; with 48 it maps each of 256 bytes to a
    place (from 1, 0: none); with 256 there are no keys and `kids` is indexed by the byte.
    """

    __slots__ = ("prefix", "places", "keys", "kids", "ends", "row", "at")

    def __init__(self, prefix: bytes, row: int, ends: tuple[int, int] | None = None):
        self.prefix, self.places, self.keys, self.kids, self.ends, self.row, self.at = prefix, 4, bytearray(), [], ends, row, 0

    def child(self, byte: int) -> Node | None:
        if self.places <= 16:
            place = self.keys.find(byte)
            return self.kids[place] if place >= 0 else None
        if self.places == 48:
            place = self.keys[byte]
            return self.kids[place - 1] if place else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Adds a child, or takes the place of the one there is."""
        if self.places <= 16:
            place = self.keys.find(byte)
            if place >= 0:
                self.kids[place] = kid
                return
            if len(self.kids) == self.places:
                self._grow()
                return self.put(byte, kid)
            place = sum(k < byte for k in self.keys)
            self.keys.insert(place, byte)
            self.kids.insert(place, kid)
        elif self.places == 48:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = kid
            elif len(self.kids) == 48:
                self._grow()
                self.put(byte, kid)
            else:
                self.kids.append(kid)
                self.keys[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        if self.places == 4:
            self.places = 16
        elif self.places == 16:
            index = bytearray(256)
            for place, byte in enumerate(self.keys, 1):
                index[byte] = place
            self.places, self.keys = 48, index
        else:
            self.places, self.kids, self.keys = 256, [self.kids[p - 1] if p else None for p in self.keys], bytearray()

    def children(self) -> list[Node]:
        """In the order of their bytes."""
        if self.places == 48:
            return [self.kids[p - 1] for p in self.keys if p]
        return [k for k in self.kids if k is not None]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def insert(root: Node, key: bytes, row: int, ends: tuple[int, int]) -> None:
    """Puts a key into the tree; `row` is its place in the batch, `ends` the places of all conversations equal to it."""
    node, at = root, 0
    while True:
        same = _common(node.prefix, key[at : at + len(node.prefix)])
        if same < len(node.prefix):
            # the prefix parts here: what was the node becomes a child
            low = Node(node.prefix[same + 1 :], node.row, node.ends)
            low.places, low.keys, low.kids = node.places, node.keys, node.kids
            byte = node.prefix[same]
            node.prefix, node.places, node.keys, node.kids, node.ends = node.prefix[:same], 4, bytearray(), [], None
            node.put(byte, low)
        at += same
        if at == len(key):
            node.ends = ends
            return
        kid = node.child(key[at])
        if kid is None:
            node.put(key[at], Node(key[at + 1 :], row, ends))
            return
        node, at = kid, at + 1


def radix_tree(keys: list[bytes]) -> Node:
    """The tree of sorted keys, which may repeat; the root has an empty prefix."""
    root, a = Node(b"", 0), 0
    while a < len(keys):
        b = a + 1
        while b < len(keys) and keys[b] == keys[a]:
            b += 1
        insert(root, keys[a], a, (a, b))
        a = b
    return root


_FOUND = {
    "batch": pa.int64(), "node": pa.binary(), "parent": pa.binary(), "parent_conv_id": pa.int64(), "conv_id": pa.int64(),
    "depth": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(), "above": pa.int64(), "size": pa.int64(), "on_first": pa.bool_(), "on_last": pa.bool_(),
    "end_of": pa.int32(), "ends": pa.string(),
}
FOUND = (
    "batch long, node binary, parent binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, above long, size long, on_first boolean, on_last boolean, end_of int, ends string"
)
#: `end_of`: the node is where the batch's first (1) or last (2) conversation ends.
FIRST, LAST = 1, 2


def batch_nodes(batch: int, convs: list[int], keys: list[bytes], sizes: list[bytes]) -> Iterator[tuple]:
    """Rows of FOUND for one batch of conversations, which are sorted by (key, conv_id).

    Inner nodes are final but for the parent's conv_id where the parent is an edge node; edge nodes (with `node`, a
    digest of their ids) hold what this batch adds to them. `above` is the length of all texts down to the node.
    """
    root = radix_tree(keys)

    def size(row: int, depth: int) -> int:
        return int.from_bytes(sizes[row][SIZE * depth - SIZE : SIZE * depth], "big") if depth else 0

    order, stack = [], [(root, None)]
    while stack:
        node, parent = stack.pop()
        start = -1 if parent is None else parent.at
        node.at = (0 if parent is None else start + 1) + len(node.prefix)
        order.append((node, parent, start))
        stack += [(kid, node) for kid in reversed(node.children())]
    facts: dict[int, tuple] = {}  # n, least conv_id, leaves, saved, tops: nodes of the trie right below the parent
    shown: dict[int, tuple] = {}  # n, least conv_id, the trie's nodes on this node's bytes
    for node, _, start in reversed(order):
        below = [facts.pop(id(kid)) for kid in node.children()]
        n, least = sum(f[0] for f in below), min((f[1] for f in below), default=None)
        leaves, saved, tops = (sum(f[i] for f in below) for i in (2, 3, 4))
        if node.ends:
            a, b = node.ends
            n, least = n + b - a, convs[a] if least is None else min(least, convs[a])
        levels = []
        for depth in range(node.at // WIDTH, start // WIDTH, -1):
            children, leaves = tops, leaves if tops else 1
            saved, tops = saved + (n - 1) * size(node.row, depth), 1
            levels.append((depth, children, leaves, saved))
        shown[id(node)] = (n, least, levels[::-1])
        facts[id(node)] = (n, least, leaves, saved, tops)
    first, last = keys[0], keys[-1]
    up: dict[int, tuple] = {}  # the trie node above: its digest if it is an edge node, its conv_id if not; lengths so far
    for node, parent, _ in order:
        over = up[id(parent)] if parent else (None, None, 0)
        n, least, levels = shown[id(node)]
        for depth, children, leaves, saved in levels:
            path = keys[node.row][: WIDTH * depth]
            on_first, on_last = first.startswith(path), last.startswith(path)
            mine = size(node.row, depth)
            above, ending = over[2] + mine, node.ends if WIDTH * depth == node.at else None
            if not (on_first or on_last):
                text = ",".join(map(str, convs[slice(*ending)])).encode() if ending else b""
                digest = hashlib.sha256(text).hexdigest() if ending else NOBODY
                yield (batch, None, over[0], over[1], least, depth, n, children, leaves, saved, digest, above, mine, None, None, None, None)
                over = (None, least, above)
            else:
                digest = hashlib.blake2b(path, digest_size=16).digest()
                end_of = FIRST if len(path) == len(first) and on_first else LAST if len(path) == len(last) and on_last else None
                text = ",".join(map(str, convs[slice(*ending)])) if ending else None
                yield (batch, digest, over[0], None, least, depth, n, children, leaves, saved, None, above, mine, on_first, on_last, end_of, text)
                over = (digest, None, above)
        up[id(node)] = over


#: Rows sent on at once.
SENT = 1 << 14


def _build(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        convs, keys, sizes, held = [], [], [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            rows = []
            for row in batch_nodes(number, convs, keys, sizes):
                rows.append(row)
                if len(rows) == SENT:
                    yield _record(rows)
                    rows = []
            if rows:
                yield _record(rows)

        for batch in slices(batches):
            for c, k, s in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "sizes"))):
                convs.append(c)
                keys.append(k)
                sizes.append(s)
                held += len(k)
                if len(convs) == most or held > BATCH_BYTES:
                    yield from sent()
                    number, convs, keys, sizes, held = number + 1, [], [], [], 0
        if convs:
            yield from sent()

    return run


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _FOUND.values())], list(_FOUND))


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node over its pieces, which come sorted by node and batch; the state is one running hash."""
    current, running = None, None

    def sent() -> pa.RecordBatch:
        return pa.record_batch([pa.array([current], pa.binary()), pa.array([running.hexdigest()])], ["node", "ends_sha256"])

    for batch in batches:
        for node, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if node != current:
                if current is not None:
                    yield sent()
                current, running = node, hashlib.sha256()
            else:
                running.update(b",")
            running.update(piece.encode())
    if current is not None:
        yield sent()


def _edge_nodes(edges: DataFrame) -> DataFrame:
    """Edge nodes added up over the batches that hold them, one row each."""
    known = edges.groupBy("node").agg(F.min("batch").alias("owner"), F.max("n_children").alias("any_child"))
    rows = materialise(edges.join(known, "node").drop("ends"), "trie-edges")
    shared = F.col("owner") < F.col("batch")
    # a batch counts a leaf where its first or last conversation ends without a child in the batch
    wrong = (F.col("n_children") == 0) & (shared | (F.col("any_child") > 0))
    verdict = rows.groupBy("batch").agg(
        F.max(F.when(F.col("on_first") & shared, F.col("depth"))).alias("theirs"),
        F.max(F.when(F.col("on_first") & shared, F.col("above"))).alias("theirs_above"),
        F.max(F.when((F.col("end_of") == FIRST) & wrong, 1).otherwise(0)).alias("first_wrong"),
        F.max(F.when((F.col("end_of") == LAST) & wrong, 1).otherwise(0)).alias("last_wrong"),
    )
    first, last = F.col("on_first").cast("int"), F.col("on_last").cast("int")
    theirs = F.coalesce("theirs", F.lit(-1))
    children = F.col("n_children") - F.when(F.col("on_first") & (F.col("depth") < theirs), 1).otherwise(0)
    # texts of nodes that an earlier batch owns were taken off there
    again = F.when(F.col("on_first") & (F.col("depth") <= theirs), F.col("theirs_above") - F.col("above") + F.col("size")).otherwise(0)
    return (
        rows.join(verdict, "batch")
        .groupBy("node", "parent", "depth")
        .agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum(children).alias("n_children"),
            F.sum(F.col("n_leaves") - first * F.col("first_wrong") - last * F.col("last_wrong")).alias("n_leaves"),
            F.sum(F.col("saved_tokens") + again).alias("saved_tokens"),
        )
    )


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(sequences: DataFrame, batch: int = BATCH) -> DataFrame:
    """One row per node of the trie of `sequences` (conv_id, ids, sizes).

    conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, each node's members but one times the length of its last text), ends_sha256 (of the
    members that end here: decimal ids, ascending, joined by commas).
    """
    rows = materialise(sequences, "trie-sequences")
    ordered = rows.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    found = materialise(ordered.mapInArrow(_build(batch), FOUND), "trie-found")
    edges = materialise(_edge_nodes(found.where("node IS NOT NULL")), "trie-edge-nodes")
    pieces = found.where("ends IS NOT NULL").select("node", "batch", "ends")
    pieces = pieces.repartition("node").sortWithinPartitions("node", "batch")
    hashes = pieces.mapInArrow(_hash_pieces, "node binary, ends_sha256 string")
    of = edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("edge_conv_id"))
    done = edges.join(hashes, "node", "left").join(of, "parent", "left")
    done = done.withColumns({"parent_conv_id": F.col("edge_conv_id"), "ends_sha256": F.coalesce("ends_sha256", F.lit(NOBODY))})
    inner = found.where("node IS NULL").join(of, "parent", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("edge_conv_id", "parent_conv_id"))
    return inner.select(*RESULT).unionAll(done.select(*RESULT))
