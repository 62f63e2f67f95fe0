"""The conversations of all leads as one prefix tree of turns.

A turn is a 16-byte id, a conversation the string of its ids. The strings are
range-sorted, and each task grows adaptive radix trees over its stretch of them. A node of the
result is a turn-aligned depth of such a tree; nodes shared by neighbouring
stretches are put together from what each stretch adds to them. A hot opening or a hot
conversation is so many equal strings, which the sort deals over as many stretches as their number needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.llm.rows import stream_rows
from contactmill.session import cut_lineage

WIDTH = 16
ROOT = bytes(WIDTH)
# After the ids of a piece that its conversation goes beyond.
GOES_ON = b"\x01"
# Turns of a conversation in one string; a longer conversation becomes several, each led by the id of the node it hangs on.
PIECE_TURNS = 512
# A radix tree is closed at this many strings or bytes.
TREE_ROWS, TREE_BYTES = 50_000, 32 << 20

PIECES = "lead_id long, level long, last boolean, key binary, chars binary, n_chars long"
GROWN = (
    "part long, node binary, parent binary, lead_id long, parent_lead_id long, depth long, n_leads long, "
    "n_children long, n_leaves long, saved_chars long, ends_sha256 string, ends string, first_end long"
)
JOINTS = "node binary, parent binary, lead_id long, inner_parent long, depth long, n_leads long, n_children long, n_leaves long, saved_chars long, ends_sha256 string"
RESULT = ["lead_id", "depth", "parent_lead_id", "n_leads", "n_children", "n_leaves", "saved_chars", "ends_sha256"]


# --- adaptive radix tree -------------------------------------------------------
class Few:
    """Children under up to ``room`` sorted key bytes."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node):
        """The layout that holds the child: this one or, if it is full, a larger one."""
        at = self.bytes.find(byte)
        if at >= 0:
            self.nodes[at] = node
            return self
        if len(self.nodes) == self.room:
            larger = Few(16) if self.room == 4 else Some()
            for b, n in self.items():
                larger.put(b, n)
            return larger.put(byte, node)
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self):
        return zip(self.bytes, self.nodes)


class Some:
    """Up to 48 children behind an index by byte."""

    __slots__ = ("slots", "nodes")

    def __init__(self):
        self.slots, self.nodes = bytearray(256), []

    def get(self, byte: int):
        slot = self.slots[byte]
        return self.nodes[slot - 1] if slot else None

    def put(self, byte: int, node):
        if self.slots[byte]:
            self.nodes[self.slots[byte] - 1] = node
            return self
        if len(self.nodes) == 48:
            larger = All()
            for b, n in self.items():
                larger.put(b, n)
            return larger.put(byte, node)
        self.nodes.append(node)
        self.slots[byte] = len(self.nodes)
        return self

    def items(self):
        return ((b, self.nodes[s - 1]) for b, s in enumerate(self.slots) if s)


class All:
    """A place for every byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def items(self):
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class Node:
    """A compressed path: the bytes since the branch above, then the end of a string, branches, or both."""

    __slots__ = ("path", "kids", "end")

    def __init__(self, path: bytes, end=None):
        self.path, self.kids, self.end = path, None, end

    def put(self, byte: int, node) -> None:
        self.kids = (self.kids or Few()).put(byte, node)


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


class RadixTree:
    """Adaptive radix tree with path compression; each stored string has an end made by ``make``."""

    def __init__(self, make):
        self.root, self.make = Node(b""), make

    def end_of(self, key: bytes):
        """The end of a string, which is put in if it is new."""
        node, at = self.root, 0
        while True:
            same = common(node.path, key[at : at + len(node.path)])
            if same < len(node.path):
                below = Node(node.path[same + 1 :], node.end)
                below.kids = node.kids
                byte, node.path = node.path[same], node.path[:same]
                node.kids, node.end = None, None
                node.put(byte, below)
            at += same
            if at == len(key):
                if node.end is None:
                    node.end = self.make()
                return node.end
            child = node.kids.get(key[at]) if node.kids else None
            if child is None:
                child = Node(key[at + 1 :], self.make())
                node.put(key[at], child)
                return child.end
            node, at = child, at + 1

    def top_down(self) -> list[tuple[Node, int, int]]:
        """Every node with the bytes above its path and the place of its parent in this list."""
        out, todo = [], [(self.root, 0, -1)]
        while todo:
            node, above, parent = todo.pop()
            out.append((node, above, parent))
            if node.kids:
                place, below = len(out) - 1, above + len(node.path) + 1
                todo += [(child, below, place) for _, child in node.kids.items()]
        return out


class End:
    """The conversations whose string ends here, and what lies beyond those that go on."""

    __slots__ = ("key", "chars", "level", "leads", "n", "low", "goes_on", "saved_after", "leaves_after")

    def __init__(self):
        self.key, self.leads, self.n, self.low, self.goes_on = None, [], 0, None, False
        self.saved_after = self.leaves_after = 0


def node_id(key: bytes, turns: int) -> bytes:
    """The id of the node ``turns`` ids below the head of a string."""
    return key[:WIDTH] if turns == 0 else hashlib.sha256(key[: WIDTH * (turns + 1)]).digest()[:WIDTH]


class Stretch:
    """A run of the sorted strings: its radix tree, and what it adds to the nodes of the result."""

    def __init__(self, part: int, before: bytes, piece_turns: int, tree_rows: int = TREE_ROWS):
        self.part, self.before, self.piece_turns, self.tree_rows = part, before, piece_turns, tree_rows
        self.tree, self.first, self.last, self.rows, self.bytes = RadixTree(End), None, None, 0, 0
        self._end = None

    def add(self, key: bytes, lead: int, level: int, last: bool, chars: bytes, beyond: tuple) -> None:
        if key != self.last:
            self._end = end = self.tree.end_of(key)
            end.key, end.chars, end.level, end.goes_on = key, np.frombuffer(chars, "<i8"), level, not last
            self.first, self.last = self.first or key, key
            self.bytes += len(key) + len(chars)
        self.rows += 1
        end = self._end
        end.n += 1
        end.low = lead if end.low is None else min(end.low, lead)
        if last:
            end.leads.append(lead)
        end.saved_after += beyond[0]
        end.leaves_after += beyond[1]

    def full(self) -> bool:
        return self.rows >= self.tree_rows or self.bytes >= TREE_BYTES

    def close(self, after: bytes) -> Iterator[tuple]:
        """Rows of ``GROWN``. A node that a neighbouring stretch may hold too has its id and adds up with the others of that id."""
        shared = common(self.before, self.first), common(self.last, after)
        listed = self.tree.top_down()
        sums: list = [None] * len(listed)
        for place in range(len(listed) - 1, -1, -1):
            node, above, parent = listed[place]
            n, low, leaves, saved, tops, sample, open_end = sums[place] or (0, None, 0, 0, [], None, False)
            sums[place] = None
            end = node.end
            if end is not None:
                n, low = n + end.n, end.low if low is None else min(low, end.low)
                leaves, saved, sample = leaves + end.leaves_after, saved + end.saved_after, end
                open_end = open_end or end.goes_on
            bottom = above + len(node.path)
            for size in range(bottom // WIDTH * WIDTH, max(above, WIDTH) - 1, -WIDTH):
                key, turns = sample.key, size // WIDTH - 1
                prefix = key[:size]
                known = size <= shared[0] and self.before[:size] == prefix
                follows = size <= shared[1] and after[:size] == prefix
                ends = end.leads if end is not None and size == bottom else []
                children = sum(not row["known"] for row in tops)
                if turns:
                    chars = int(sample.chars[turns - 1])
                    saved += n * chars - (0 if known else chars)
                    if not tops and not follows and not open_end:
                        leaves += 1
                elif not sample.level and not tops and not follows:
                    leaves += 1
                row = {
                    "known": known, "open": known or follows or turns == 0 or open_end and not tops,
                    "key": key, "turns": turns, "lead": low, "depth": sample.level * self.piece_turns + turns,
                    "sums": (n, children, leaves, saved), "ends": ends, "hangs_on": None, "head": turns == 0 and sample.level > 0,
                }
                for child in tops:
                    child["hangs_on"] = row
                    yield self._row(child)
                tops, open_end = [row], False
            if parent >= 0:
                held = sums[parent] or (0, None, 0, 0, [], None, False)
                both = [x for x in (held[1], low) if x is not None]
                sums[parent] = (
                    held[0] + n, min(both) if both else None, held[2] + leaves, held[3] + saved, held[4] + tops, held[5] or sample, held[6] or open_end,
                )
            else:
                yield from (self._row(row) for row in tops)

    def _row(self, row: dict) -> tuple:
        n, children, leaves, saved = row["sums"]
        above = row["hangs_on"]
        joint = above is not None and above["open"]
        parent = node_id(row["key"], row["turns"] - 1) if joint else None
        lead = None if joint or above is None else above["lead"]
        if row["head"]:
            # The node itself belongs to the string above; only its children are seen here.
            return self.part, node_id(row["key"], 0), None, None, None, row["depth"], 0, children, 0, 0, None, None, None
        ends = ",".join(map(str, row["ends"]))
        if row["open"]:
            first = row["ends"][0] if row["ends"] else None
            return self.part, node_id(row["key"], row["turns"]), parent, row["lead"], lead, row["depth"], n, children, leaves, saved, None, ends, first
        return self.part, None, parent, row["lead"], lead, row["depth"], n, children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest(), None, None


# --- on Spark -------------------------------------------------------------------
def turn_ids(interactions: DataFrame) -> DataFrame:
    """``lead_id, place, turn, n_chars``: the interactions of each lead, numbered from 1, each as a 16-byte id of its type and body.

    They follow ``id`` (nulls first; ties: type, then the turn's id). A null type or body is empty. Interactions without a lead belong to no conversation.
    """
    kind, body = F.coalesce("type", F.lit("")), F.coalesce("body", F.lit(""))
    digest = F.sha2(F.concat(F.length(kind).cast("string"), F.lit(":"), kind, body), 256)
    named = interactions.where(F.col("lead_id").isNotNull()).select(
        F.col("lead_id").cast("long"), F.col("id").alias("_id"), kind.alias("_kind"),
        F.unhex(F.substring(digest, 1, 2 * WIDTH)).alias("turn"), F.length(body).cast("long").alias("n_chars"),
    )
    order = Window.partitionBy("lead_id").orderBy(F.col("_id").asc_nulls_first(), "_kind", "turn")
    return named.withColumn("place", F.row_number().over(order).cast("long")).select("lead_id", "place", "turn", "n_chars")


def share_openings(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The turns of every lead with its first ones taken from the lead that its group begins with.

    Lead c takes the first h turns (all, if fewer) of lead c - c % ``group``, h being crc32(c) % ``most``, in place of its own first h.
    A lead left without turns keeps a row without a turn.
    """
    taken = (F.crc32(F.col("lead_id").cast("string")) % most).cast("long")
    leads = turns.select("lead_id").distinct().withColumns({"h": taken, "first": F.col("lead_id") - F.col("lead_id") % group})
    openings = turns.where((F.col("lead_id") % group == 0) & (F.col("place") < most)).withColumnRenamed("lead_id", "first")
    shared = leads.join(openings, "first").where(F.col("place") <= F.col("h")).select(*turns.columns)
    own = turns.where(F.col("place") > taken)
    none = leads.select("lead_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("n_chars"))
    return own.unionByName(shared).unionByName(none)


def _pieces(turns: DataFrame, piece_turns: int) -> DataFrame:
    """Conversations as strings; streams the turns of a lead in order and holds one piece."""
    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        lead = head = None
        level, ids, chars = 0, [], []

        def piece(last: bool) -> tuple:
            key = head + b"".join(ids) + (b"" if last else GOES_ON)
            return lead, level, last, key, np.array(chars, "<i8").tobytes(), sum(chars)

        for lead_id, turn, n in rows:
            if lead_id != lead:
                if lead is not None:
                    yield piece(True)
                lead, head, level, ids, chars = lead_id, ROOT, 0, [], []
            if turn is None:
                continue
            if len(ids) == piece_turns:
                yield piece(False)
                head, level, ids, chars = node_id(head + b"".join(ids), len(ids)), level + 1, [], []
            ids.append(turn)
            chars.append(n)
        if lead is not None:
            yield piece(True)

    ordered = turns.repartition("lead_id").sortWithinPartitions("lead_id", "place").select("lead_id", "turn", "n_chars")
    return stream_rows(ordered, cut, PIECES)


def _in_stretches(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "kind", "key", "lead_id").select("part", "kind", "key", "lead_id", *columns)


def _beyond(placed: DataFrame, borders: DataFrame) -> DataFrame:
    """``lead_id, level, saved_after, leaves_after`` for the pieces that go on: what the later pieces of the same conversation add."""
    def news(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, before = None, b""

        def settle(held: tuple, after: bytes) -> tuple:
            key, lead, level, last, chars, n_chars = held
            known = common(before, key) // WIDTH - 1
            new = int(np.frombuffer(chars, "<i8")[max(known, 0) :].sum())
            return lead, level, n_chars - new, int(last and not after.startswith(key))

        for part, kind, key, lead, level, last, chars, n_chars in rows:
            if held is not None:
                yield settle(held, key or b"")
                before, held = held[0], None
            if kind == 1:
                held = (key, lead, level, last, chars, n_chars)
            else:
                before = key or b""
        if held is not None:
            yield settle(held, b"")

    later = placed.where("level > 0").withColumn("kind", F.lit(1))
    streamed = _in_stretches(
        later.unionByName(borders.join(later.select("part").distinct(), "part", "left_semi"), allowMissingColumns=True), ["level", "last", "chars", "n_chars"]
    )
    added = stream_rows(streamed, news, "lead_id long, level long, saved long, leaves long")
    rest = Window.partitionBy("lead_id").orderBy(F.desc("level"))
    return added.select(
        "lead_id", (F.col("level") - 1).alias("level"), F.sum("saved").over(rest).alias("saved_after"), F.sum("leaves").over(rest).alias("leaves_after")
    )


def prefix_tree(turns: DataFrame, piece_turns: int = PIECE_TURNS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """One row per distinct beginning of a conversation: ``lead_id, depth, parent_lead_id, n_leads, n_children, n_leaves, saved_chars, ends_sha256``.

    ``turns`` comes from ``turn_ids``, perhaps by way of ``share_openings``: the interactions of each lead are its
    conversation; a row without a turn stands for a lead without any. The first ``depth`` turns make a node; the root has
    none. ``n_leads`` leads begin with it, ``lead_id`` is the smallest of them and, with the depth, names the node;
    ``parent_lead_id`` is that of the node one turn shorter (null for the root). ``n_children`` are the nodes one turn longer,
    ``n_leaves`` the nodes without such below it, itself included. ``saved_chars`` adds up, over it and all below,
    the characters that storing the last turn once saves: (n_leads - 1) times its length. ``ends_sha256`` is the digest of the leads whose
    conversation ends here, in ascending order, joined by commas.

    An empty table has no nodes. Turns are compared by 128 bits of SHA-256. A conversation of any length is streamed in its order by one task,
    in pieces of ``piece_turns``; after that no task holds more than a stretch of the sorted pieces. The digest of one node is made by one task, from texts
    of up to ``tree_rows`` leads each. Only borders of stretches, one row per shuffle partition, meet in one task.
    """
    pieces = cut_lineage(_pieces(turns, piece_turns))
    placed = cut_lineage(pieces.orderBy("key", "lead_id").withColumn("part", F.spark_partition_id().cast("long")))
    line = Window.orderBy("part")
    edges = placed.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    edges = cut_lineage(edges.select("part", F.lag("high").over(line).alias("before"), F.lead("low").over(line).alias("after")))
    borders = edges.select("part", F.lit(0).alias("kind"), F.col("before").alias("key")).unionByName(
        edges.select("part", F.lit(2).alias("kind"), F.col("after").alias("key"))
    )
    nothing: Column = F.lit(0).cast("long")
    whole = placed.where("last").withColumns({"saved_after": nothing, "leaves_after": nothing})
    open_pieces = placed.where("NOT last").join(_beyond(placed, borders), ["lead_id", "level"])
    rows = whole.unionByName(open_pieces).withColumn("kind", F.lit(1)).unionByName(borders, allowMissingColumns=True)

    def grow(rows: Iterator[tuple]) -> Iterator[tuple]:
        stretch, before = None, b""
        for part, kind, key, lead, level, last, chars, saved_after, leaves_after in rows:
            if stretch is not None and (kind != 1 or stretch.full()):
                yield from stretch.close(key or b"")
                before, stretch = stretch.last, None
            if kind == 0:
                before = key or b""
            if kind == 1:
                stretch = stretch or Stretch(part, before, piece_turns, tree_rows)
                stretch.add(key, lead, level, last, chars, (saved_after, leaves_after))

    streamed = _in_stretches(rows, ["level", "last", "chars", "saved_after", "leaves_after"])
    grown = cut_lineage(stream_rows(streamed, grow, GROWN))

    def add_up(rows: Iterator[tuple]) -> Iterator[tuple]:
        now = None

        def done(now: list) -> tuple:
            return *now[:9], now[9].hexdigest()

        for node, _, parent, lead, inner, depth, *counts, ends in rows:
            if now is None or now[0] != node:
                if now is not None:
                    yield done(now)
                now = [node, None, None, None, depth, 0, 0, 0, 0, hashlib.sha256(), False]
            now[1] = now[1] or parent
            now[2] = lead if now[2] is None else now[2] if lead is None else min(now[2], lead)
            now[3] = inner if now[3] is None else now[3]
            now[5:9] = [a + b for a, b in zip(now[5:9], counts)]
            if ends:
                now[9].update((("," if now[10] else "") + ends).encode())
                now[10] = True
        if now is not None:
            yield done(now)

    halves = grown.where("node IS NOT NULL").repartition("node").sortWithinPartitions("node", "first_end").select(
        "node", "first_end", "parent", "lead_id", "parent_lead_id", "depth", "n_leads", "n_children", "n_leaves", "saved_chars", "ends"
    )
    joints = cut_lineage(stream_rows(halves, add_up, JOINTS))
    named = joints.select(F.col("node").alias("_node"), F.col("lead_id").alias("parent_lead_id"))
    at_joints = joints.join(named, F.col("parent") == F.col("_node"), "left").withColumn("parent_lead_id", F.coalesce("parent_lead_id", "inner_parent"))
    within = grown.where("node IS NULL AND parent IS NULL")
    # Children of a joint meet its row within their stretch, so that those of the root are spread out.
    seats = grown.where("node IS NOT NULL").select("part", "node").distinct().join(named, F.col("node") == F.col("_node")).select(
        F.col("part").alias("_part"), "_node", "parent_lead_id"
    )
    below = grown.where("node IS NULL AND parent IS NOT NULL").drop("parent_lead_id")
    below = below.join(seats, (F.col("part") == F.col("_part")) & (F.col("parent") == F.col("_node")))
    return at_joints.select(*RESULT).unionByName(within.select(*RESULT)).unionByName(below.select(*RESULT))
