"""Conversation prefix trie: shared beginnings of conversations, as balanced parentheses.

A node is a distinct sequence of the first d turns (role, text); its members are
the conversations that start with it.

1. Every turn becomes a digest and a word count before turns meet, every
   conversation a path: the bytes of its nodes, each the digest of its parent
   and of its turn. Equal beginnings are equal bytes.
2. Paths are spread over tasks in ranges of (path, conversation), so even a
   sequence that a third of all conversations share is split. A task reads its
   range in order and encodes shards of about ``SHARD`` nodes as balanced
   parentheses, with the weights of the nodes in preorder.
3. ``findclose`` by range min-max blocks of the excess delimits all subtrees of
   a shard; ranks of the leaf pairs "()" count leaves, cumulative arrays give
   members and savings.
4. Only nodes on the first and the last path of a shard (its spines) can go on
   in another shard. They are handed on as paths with the weights gathered so
   far and go through the same encoding, shard by shard, until one is left.
   Each round has two paths for a shard of the last one.

Defined cases: null turns sort first, equal turns by role, then by the digest of
their text; null role or text is empty; repeated rows are turns of their own;
rows without conversation id belong to no conversation; a conversation without
turns is a member of the root alone; an empty table has no nodes; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, ship, take_worker, words

#: Bytes of a node's digest in a path.
KEY = 16
#: Nodes of a shard, and the fewest paths in it (over four): a round leaves two paths of it.
SHARD, FEWEST_PATHS = 20_000, 64
#: Most ranges of one round; a task cuts its range into shards itself.
RANGES = 10_000
#: Parentheses of a block whose least excess is kept.
BLOCK = 64

NO_ENDS = hashlib.sha256(b"").hexdigest()
_FAR = np.iinfo(np.int64).max
#: Weights of the nodes of a path: words of the turn, members, least member, and
#: of the closed subtrees below: how many, their leaves, their saved words.
WEIGHTS = ("tokens", "ends", "least", "children", "leaves", "saved")
_ROW = "path binary, conv_id long, " + ", ".join(f"{w} array<long>" for w in WEIGHTS)
_NODE = "key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_OUT = f"node struct<{_NODE.replace(' ', ':').replace(',:', ',')}>, spine struct<{_ROW.replace(' ', ':').replace(',:', ',')}>"


def turn_lists(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, said``: digest and words of every turn, in order."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    # the length of the role goes in, so no two pairs of role and text read alike
    digest = F.unhex(F.md5(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, what)))
    own = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), who.alias("role"), digest.alias("digest"), F.size(words(what)).cast("long").alias("tokens")).alias("said"))
    ordered = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    return ordered.select("conv_id", F.transform("said", lambda t: F.struct(t["digest"].alias("digest"), t["tokens"].alias("tokens"))).alias("said"))


def node_paths(lists: DataFrame) -> DataFrame:
    """``path, conv_id`` and the weights of every conversation: one member at the end of its path."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("trie")
        for batch in batches:
            paths, tokens = [], []
            for said in batch.column(1).to_pylist():
                key, keys, counts = bytes(KEY), [], [0]
                for t in said:
                    key = hashlib.blake2b(t["digest"], digest_size=KEY, key=key).digest()
                    keys.append(key)
                    counts.append(t["tokens"])
                paths.append(b"".join(keys))
                tokens.append(counts)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), batch.column(0), pa.array(tokens, pa.list_(pa.int64()))], names=["path", "conv_id", "tokens"])

    made = lists.select("conv_id", "said").mapInArrow(build, "path binary, conv_id long, tokens array<long>")
    return made.select("*", *[F.lit(None).cast("array<long>").alias(w) for w in WEIGHTS[1:]])


def find_close(bits: np.ndarray) -> np.ndarray:
    """Position of the closing parenthesis of every opening one, in order.

    The close of an opening at i is the first j > i whose excess falls below the
    excess at i. Least excesses of blocks stand in a balanced tree: a search
    ends inside its own block or climbs until a block to the right reaches low
    enough, then descends to it. All searches take each step together.
    """
    excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int64)
    opens = np.flatnonzero(bits)
    aim = excess[opens] - 1
    blocks = -(-len(bits) // BLOCK)
    wide = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
    wide[: len(bits)] = excess
    grid = wide.reshape(blocks, BLOCK)
    leaves = 1 << max(0, math.ceil(math.log2(max(blocks, 1))))
    tree = np.full(2 * leaves, np.iinfo(np.int64).max)
    tree[leaves: leaves + blocks] = grid.min(axis=1)
    for level in range(leaves.bit_length() - 2, -1, -1):
        at = np.arange(1 << level, 1 << (level + 1))
        tree[at] = np.minimum(tree[2 * at], tree[2 * at + 1])
    out = np.full(len(opens), -1, np.int64)
    step = 1 << 15  # searches handled together: a block row for each
    for a in range(0, len(opens), step):
        i, low = opens[a: a + step], aim[a: a + step]
        hit = (grid[i // BLOCK] <= low[:, None]) & (np.arange(BLOCK) > (i % BLOCK)[:, None])
        found = hit.any(axis=1)
        place = np.where(found, (i // BLOCK) * BLOCK + hit.argmax(axis=1), -1)
        rest = np.flatnonzero(~found)
        node = i[rest] // BLOCK + leaves
        climbing = np.ones(len(rest), bool)
        while climbing.any():
            right = node + 1
            stop = climbing & (node % 2 == 0) & (tree[np.minimum(right, 2 * leaves - 1)] <= low[rest])
            node = np.where(stop, right, np.where(climbing, node // 2, node))
            climbing &= ~stop
        while (node < leaves).any():
            inner = node < leaves
            left = np.minimum(2 * node, 2 * leaves - 1)
            node = np.where(inner, np.where(tree[left] <= low[rest], left, left + 1), node)
        block = node - leaves
        if len(rest):
            place[rest] = block * BLOCK + (grid[block] <= low[rest][:, None]).argmax(axis=1)
        out[a: a + step] = place
    return out


class Shard:
    """The trie of a run of sorted paths: parentheses and weights in preorder."""

    def __init__(self) -> None:
        self.bits: list[int] = []
        self.keys: list[bytes] = []
        self.depths: list[int] = []
        self.weights: dict[str, list[int]] = {w: [] for w in WEIGHTS}
        self.open: list[int] = []
        self.last = b""
        self.first: list[int] = []
        self.paths = 0
        self.hashes: dict[int, object] = {}

    def add(self, path: bytes, conv_id: int | None, rows: dict[str, list[int] | None]) -> None:
        """One path; ``rows`` are its weights, without ``ends`` that of one conversation."""
        turns = len(path) // KEY
        shared = 0
        if self.paths:
            most = min(turns, len(self.last) // KEY)
            if path[: most * KEY] == self.last[: most * KEY]:
                shared = most + 1
            else:
                while path[shared * KEY: (shared + 1) * KEY] == self.last[shared * KEY: (shared + 1) * KEY]:
                    shared += 1
                shared += 1
        self.bits.extend([0] * (len(self.open) - shared))
        del self.open[shared:]
        for d in range(shared, turns + 1):
            self.bits.append(1)
            self.open.append(len(self.keys))
            self.keys.append(path[(d - 1) * KEY: d * KEY] if d else b"")
            self.depths.append(d)
            for w in WEIGHTS:
                self.weights[w].append(_FAR if w == "least" else 0)
            self.weights["tokens"][-1] = rows["tokens"][d]
        if rows["ends"] is None:
            end = self.open[turns]
            self.weights["ends"][end] += 1
            self.weights["least"][end] = min(self.weights["least"][end], conv_id)
            seen = self.hashes.get(end)
            if seen is None:
                self.hashes[end] = hashlib.sha256(str(conv_id).encode())
            else:  # paths come with rising ids
                seen.update(f",{conv_id}".encode())
        else:
            for w in WEIGHTS[1:]:
                mine = self.weights[w]
                for d, value in enumerate(rows[w]):
                    at = self.open[d]
                    mine[at] = min(mine[at], value) if w == "least" else mine[at] + value
        if not self.paths:
            self.first = list(self.open)
        self.last = path
        self.paths += 1

    def full(self) -> bool:
        return len(self.keys) >= SHARD and self.paths >= FEWEST_PATHS

    def close(self, whole: bool) -> pa.RecordBatch:
        """Finished nodes and, unless the shard is the ``whole`` trie, its spines."""
        bits = np.asarray(self.bits + [0] * len(self.open), bool)
        n = len(self.keys)
        w = {k: np.asarray(v, np.int64) for k, v in self.weights.items()}
        depth = np.asarray(self.depths, np.int64)
        stop = find_close(bits)
        start = np.flatnonzero(bits)
        first, until = np.arange(n), np.arange(n) + (stop - start + 1) // 2

        def below(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[until] - total[first]

        # the parent is the nearest node before that is one level up
        parent = np.full(n, -1, np.int64)
        line: list[int] = []
        for v, d in enumerate(self.depths):
            del line[d:]
            if line:
                parent[v] = line[-1]
            line.append(v)
        pairs = bits[start] & ~bits[np.minimum(start + 1, len(bits) - 1)]
        ranks = np.cumsum(pairs & (w["children"] == 0))  # leaf pairs up to a node
        leaves = ranks[until - 1] - ranks + (pairs & (w["children"] == 0)) + below(w["leaves"])
        convs = below(w["ends"])
        children = w["children"] + np.bincount(parent[parent >= 0], minlength=n)
        least = w["least"].copy()
        for v in range(n - 1, 0, -1):  # children come after their parents
            if least[v] < least[parent[v]]:
                least[parent[v]] = least[v]

        spine = np.zeros(n, bool)
        if not whole:
            spine[self.first] = True
            spine[self.open] = True
        own = np.where(spine, 0, (convs - 1) * w["tokens"])  # what a spine node saves shows when all its members are counted
        saved = below(own + w["saved"])
        done = np.flatnonzero(~spine)
        up = parent[done]
        known = (up >= 0) & ~spine[np.maximum(up, 0)]
        nodes = pa.StructArray.from_arrays([
            pa.array([self.keys[v] for v in done], pa.binary()),
            pa.array([self.keys[p] if p >= 0 else None for p in up], pa.binary()),
            pa.array(depth[done]), pa.array(least[done]),
            pa.array(least[np.maximum(up, 0)], mask=~known),
            pa.array(convs[done]), pa.array(children[done]), pa.array(leaves[done]), pa.array(saved[done]),
            pa.array([self.hashes[v].hexdigest() if v in self.hashes else None for v in done], pa.string()),
        ], names=[c.split()[0] for c in _NODE.split(", ")])
        out_nodes, out_spines = [nodes], [pa.nulls(len(nodes), _type(_ROW))]
        if not whole:
            # closed subtrees are handed on with the spine node they hang on
            hung = done[spine[np.maximum(up, 0)]]
            on = parent[hung]
            gathered = {k: w[k].copy() for k in WEIGHTS}
            for k, values in (("ends", convs), ("leaves", leaves), ("saved", saved)):
                np.add.at(gathered[k], on, values[hung])
            np.add.at(gathered["children"], on, 1)
            np.minimum.at(gathered["least"], on, least[hung])
            rows = [self.first]
            again = set(self.first)
            if self.open != self.first:
                rows.append(self.open)
            spines = []
            for i, line in enumerate(rows):
                one: dict[str, object] = {"path": b"".join(self.keys[v] for v in line), "conv_id": None, "tokens": [int(w["tokens"][v]) for v in line]}
                for k in WEIGHTS[1:]:
                    blank = _FAR if k == "least" else 0
                    one[k] = [blank if i and v in again else int(gathered[k][v]) for v in line]
                spines.append(one)
            out_nodes.append(pa.nulls(len(spines), _type(_NODE)))
            out_spines.append(pa.array(spines, _type(_ROW)))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(_type(_NODE)) for x in out_nodes]), pa.concat_arrays(out_spines)], names=["node", "spine"])


def _type(columns: str) -> pa.DataType:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.struct([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])


def _round(rows: DataFrame, ranges: int, whole: bool) -> DataFrame:
    """One round of encoding: ``node, spine``, one of them set in each row."""
    spread = rows.repartitionByRange(ranges, "path", "conv_id") if ranges > 1 else rows.coalesce(1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("trie")
        shard = Shard()
        for batch in batches:
            for row in batch.to_pylist():
                if shard.full() and not whole:
                    yield shard.close(False)
                    shard = Shard()
                shard.add(row["path"], row["conv_id"], row)
        if shard.paths:
            yield shard.close(whole)

    return cut(spread.sortWithinPartitions("path", "conv_id").mapInArrow(build, _OUT), "trie")


def end_digests(ends: DataFrame) -> DataFrame:
    """``key, ends``: SHA-256 of the comma-joined ids of each key, in rising order.

    Ids stream through a hash that is kept from row to row, so a node at which
    many conversations end takes no more memory than another.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, state = None, None
        for batch in batches:
            keys, hashes = [], []
            for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is not None and key == kept:
                    state.update(f",{conv_id}".encode())
                    continue
                if state is not None:
                    keys.append(kept)
                    hashes.append(state.hexdigest())
                kept, state = key, hashlib.sha256(str(conv_id).encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([kept], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends"])

    dealt = ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return dealt.mapInArrow(build, "key binary, ends string")


def trie(lists: DataFrame) -> DataFrame:
    """All nodes of the trie of ``conv_id, said`` (see ``turn_lists``): one row each."""
    ship(lists.sparkSession)
    paths = cut(node_paths(lists), "paths")
    rows, finished, last = paths, [], False
    while not last:
        size, count = rows.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)), F.count(F.lit(1))).first()
        # with enough paths in a range and in a shard the spines are a fraction of the paths
        ranges = max(1, min(RANGES, -(-size // SHARD), count // FEWEST_PATHS))
        last = ranges == 1
        out = _round(rows, ranges, last)
        finished.append(out.where("node IS NOT NULL").select("node.*"))
        rows = out.where("spine IS NOT NULL").select("spine.*")
    nodes = finished[0]
    if len(finished) > 1:
        later = finished[1]
        for more in finished[2:]:
            later = later.unionByName(more)
        nodes = nodes.unionByName(later)
        # only nodes that went on from shard to shard lack the digest of their members, only nodes below such a parent its id
        ends = paths.select(F.expr(f"CASE WHEN length(path) = 0 THEN path ELSE substring(path, length(path) - {KEY - 1}, {KEY}) END").alias("key"), "conv_id")
        missing = cut(end_digests(ends.join(broadcast_if_small(later.select("key")), "key", "left_semi")), "ends")
        ups = later.select(F.col("key").alias("parent"), F.col("conv_id").alias("up"))
        nodes = nodes.join(broadcast_if_small(missing), "key", "left").withColumn("ends_sha256", F.coalesce("ends", "ends_sha256"))
        nodes = nodes.join(broadcast_if_small(ups), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def branched(lists: DataFrame, share: int = 20, heads: int = 4) -> DataFrame:
    """``lists`` rebuilt: the first h turns of conversation c - c % share, then c's own behind its first h.

    h is the unsigned crc32 of c as decimal text, modulo ``heads``.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    lists = cut(lists, "turns")
    base = lists.select(F.col("conv_id").alias("base"), F.slice("said", 1, heads - 1).alias("head"))
    own = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % share).withColumn("h", h)
    both = own.join(base.where(F.col("base") % share == 0), "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("said", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("said", F.col("h") + 1, F.size("said"))).alias("said"))
