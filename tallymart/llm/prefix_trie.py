"""A trie of conversation prefixes, built from sorted neighbours.

Every distinct sequence of the first d turns (role, text) of a conversation is
a node of depth d; the conversations that start with it are its members.

Conversations are sorted by their sequence of turn keys (and conv_id) over
range partitions and written once. Within a partition, the longest common
prefix (LCP) of each two neighbours is an edge; edges are taken in descending
depth and joined by union-find, and every merge of two components at depth w
creates (or widens) the branching node of depth w whose members are the merged
interval. Between branching nodes lie chains of one-child nodes with the same
members, which are expanded. A node whose interval touches a partition border
at a depth no deeper than the LCP across that border is open: each partition
contracts its open nodes to additive pieces (members, smallest member, children
counted from their side, leaves, shared bytes), keyed by the partition where
the node starts, which a small table of border LCPs names. The pieces of a node
are then merged by one aggregation; nothing is ever gathered per group.

Counts per node, with k its interval in sorted order and d its depth:
children = #{k: L_k > d} - #{inner edges with LCP > d}; leaves = members that
end a run of equal sequences not continued by the next one; saved tokens of the
subtree = (sum of shared bytes of inner edges) - (n - 1) * bytes of the first
d - 1 turns. The conversations ending at a node come first in its interval,
in ascending conv_id, and are hashed as a stream.

Defined results: a null ``turn`` sorts first, then role and text break ties;
a null role or text is empty; rows with a null ``conv_id`` take no part;
repeated rows are repeated turns; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.session import fresh_folder, shared_folder

# Fixed values of the rebuilding rule: the group size and the head's modulus.
GROUP = 5
HEAD_MODULUS = 9

TURNS_PER_PARTITION = 200_000  # turns read per range partition, bounding a task's memory

EMPTY_HASH = hashlib.sha256(b"").hexdigest()
PIECES = (
    "depth long, key_q long, key_a long, parent_q long, parent_a long, conv_id long, n_convs long, "
    "children long, leaves long, shared long, head_bytes long, ends_sha256 string, conv_end long"
)
BORDERS = "pid int, n long, first_keys array<binary>, first_bytes array<long>, last_keys array<binary>, inner_min long"
NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``keys`` (128-bit key per turn) and ``sizes`` (UTF-8 bytes of each text).

    Conversation c takes the first h turns of conversation c - c % 5 (all if
    fewer, none if absent), then its own turns after its first h;
    h = crc32(decimal c) % 9.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The role's length first makes the pair unambiguous.
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    turns = (
        conversations.filter(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(order.alias("o"), key.alias("k"), F.octet_length(text).cast("long").alias("b")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    own = turns.select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base_id"), F.col("turns").alias("own"),
                       (F.crc32(F.col("conv_id").cast("string")) % HEAD_MODULUS).cast("int").alias("h"))
    base = turns.select(F.col("conv_id").alias("base_id"), F.col("turns").alias("base"))
    joined = own.join(base, "base_id", "left")
    head = F.slice(F.coalesce(F.col("base"), F.array().cast(joined.schema["own"].dataType)), 1, F.col("h"))
    tail = F.slice(F.col("own"), F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    whole = F.concat(head, tail)
    return joined.select("conv_id", F.transform(whole, lambda t: t["k"]).alias("keys"), F.transform(whole, lambda t: t["b"]).alias("sizes"))


def _lcp(a, b) -> int:
    n = min(len(a), len(b))
    at = 0
    while at < n and a[at] == b[at]:
        at += 1
    return at


def _borders(batches):
    """First and last sequence of a partition, and the depth down to which all of it is one node."""
    pid, n, first, first_bytes, last, inner = None, 0, None, None, None, None
    for frame in batches:
        for part, keys, sizes in zip(frame["pid"], frame["keys"], frame["sizes"]):
            keys = list(map(bytes, keys))
            if first is None:
                pid, first, first_bytes, inner = int(part), keys, [int(b) for b in sizes], len(keys)
            else:
                inner = min(inner, _lcp(last, keys))
            inner = min(inner, len(keys))
            last, n = keys, n + 1
    if n:
        yield pd.DataFrame({
            "pid": [pid], "n": [n], "first_keys": [first], "first_bytes": [first_bytes],
            "last_keys": [last], "inner_min": [inner],
        })


def border_table(rows: list) -> dict[int, tuple]:
    """Per partition id: (order, LCP and shared bytes with the one before, LCP with the one after, starts).

    ``starts[d]`` names the partition where the node of depth d that crosses
    the left border begins, for d up to the left LCP.
    """
    rows = sorted((row for row in rows if row["n"] > 0), key=lambda row: row["pid"])
    table: dict[int, tuple] = {}
    prev_starts: list[int] = []
    for q, row in enumerate(rows):
        if q == 0:
            left, shared, starts = -1, 0, []
        else:
            before = rows[q - 1]
            left = _lcp(list(map(bytes, before["last_keys"])), list(map(bytes, row["first_keys"])))
            shared = int(sum(row["first_bytes"][:left]))
            prev_left = table[before["pid"]][1]
            starts = [
                prev_starts[d] if d <= prev_left and d <= before["inner_min"] else q - 1
                for d in range(left + 1)
            ]
        right = -1
        if q + 1 < len(rows):
            right = _lcp(list(map(bytes, row["last_keys"])), list(map(bytes, rows[q + 1]["first_keys"])))
        table[row["pid"]] = (q, left, shared, right, starts)
        prev_starts = starts
    return table


class _Node:
    __slots__ = ("depth", "lo", "hi", "children", "parent", "low")

    def __init__(self, depth, lo, hi, low):
        self.depth, self.lo, self.hi, self.low = depth, lo, hi, low
        self.children: list[_Node] = []
        self.parent: _Node | None = None


def _forest(lengths: list[int], lcps: list[int], convs: list[int]) -> _Node:
    """Union-find over neighbour edges in descending LCP; the root of the compressed trie."""
    n = len(lengths)
    up = list(range(n))
    top = [_Node(lengths[k], k, k, convs[k]) for k in range(n)]

    def find(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for k in sorted(range(n - 1), key=lambda k: -lcps[k]):
        w = lcps[k]
        ra, rb = find(k), find(k + 1)
        a, b = top[ra], top[rb]
        if a.depth == w and b.depth == w:
            a.children.extend(b.children)
            for child in b.children:
                child.parent = a
            node = a
        elif a.depth == w:
            a.children.append(b)
            b.parent, node = a, a
        elif b.depth == w:
            b.children.insert(0, a)
            a.parent, node = b, b
        else:
            node = _Node(w, 0, 0, 0)
            node.children = [a, b]
            a.parent = b.parent = node
        node.lo, node.hi, node.low = a.lo, b.hi, min(a.low, b.low)
        up[rb] = ra
        top[ra] = node
    return top[find(0)]


def _pieces(borders):
    """Sorted conversations of one partition in; node pieces and open ends out."""

    def run(batches):
        frames = [frame for frame in batches if len(frame)]
        if not frames:
            return
        frame = pd.concat(frames, ignore_index=True)
        pid = int(frame["pid"].iloc[0])
        q, left, left_shared, right, starts = borders.value[pid]
        convs = [int(c) for c in frame["conv_id"]]
        keys = [list(map(bytes, k)) for k in frame["keys"]]
        sizes = [list(map(int, s)) for s in frame["sizes"]]
        n = len(convs)
        lengths = [len(k) for k in keys]
        lcps = [_lcp(keys[k], keys[k + 1]) for k in range(n - 1)]
        shared_sum = [0]
        for k in range(n - 1):
            shared_sum.append(shared_sum[-1] + sum(sizes[k + 1][: lcps[k]]))
        nexts = lcps + [right]
        leaf_sum = [0]
        for k in range(n):
            leaf_sum.append(leaf_sum[-1] + (1 if nexts[k] < lengths[k] else 0))

        def key(d, lo, hi):
            if lo == 0 and d <= left:
                return starts[d], -1
            if hi == n - 1 and d <= right:
                return q, -1
            return q, lo

        out = {name: [] for name in ("depth", "key_q", "key_a", "parent_q", "parent_a", "conv_id", "n_convs", "children", "leaves", "shared", "head_bytes", "ends_sha256", "conv_end")}

        def emit(d, kq, ka, pq, pa, low, count, children, leaves, shared, head, ends, conv_end):
            for name, value in zip(out, (d, kq, ka, pq, pa, low, count, children, leaves, shared, head, ends, conv_end)):
                out[name].append(value)

        root = _forest(lengths, lcps, convs)
        stack = [(root, -1)]
        while stack:
            node, above = stack.pop()
            stack.extend((child, node.depth) for child in node.children)
            lo, hi = node.lo, node.hi
            for d in range(above + 1, node.depth + 1):
                kq, ka = key(d, lo, hi)
                opened_left = lo == 0 and d <= left
                open_node = ka == -1
                if d == 0:
                    pq = pa = None
                elif d - 1 > above:
                    pq, pa = key(d - 1, lo, hi)
                else:
                    parent = node.parent
                    pq, pa = key(d - 1, parent.lo, parent.hi)
                children = len(node.children) if d == node.depth else 1
                if d == node.depth:
                    # Conversations ending here come first in the interval, in conv_id order.
                    ends, k = [], lo
                    while k <= hi and lengths[k] == d:
                        ends.append(convs[k])
                        k += 1
                    # Members ending here that are no child: count them apart from the children.
                else:
                    ends = []
                if opened_left and left > d:
                    children -= 1
                shared = shared_sum[hi] - shared_sum[lo] + (left_shared if opened_left else 0)
                head = sum(sizes[lo][: max(d - 1, 0)])
                leaves = leaf_sum[hi + 1] - leaf_sum[lo]
                if open_node:
                    emit(d, kq, ka, pq, pa, node.low, hi - lo + 1, children, leaves, shared, head, None, None)
                    for conv in ends:
                        emit(d, kq, ka, None, None, None, 0, 0, 0, 0, 0, None, conv)
                else:
                    digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
                    emit(d, kq, ka, pq, pa, node.low, hi - lo + 1, children, leaves, shared, head, digest, None)
            if len(out["depth"]) >= 50_000:
                yield _frame(out)
                out = {name: [] for name in out}
        if out["depth"]:
            yield _frame(out)

    return run


def _frame(out: dict[str, list]) -> pd.DataFrame:
    """Columns of nullable 64-bit integers stay exact (no float in between)."""
    return pd.DataFrame({
        name: pd.array(values, dtype="string" if name == "ends_sha256" else "Int64") for name, values in out.items()
    })


def _stream_ends(batches):
    """Sorted (node, conv_id) rows in; one hash per node out."""
    node, digest, first = None, None, True
    done = {"depth": [], "key_q": [], "ends_sha256": []}
    for frame in batches:
        for d, kq, conv in zip(frame["depth"], frame["key_q"], frame["conv_end"]):
            if (d, kq) != node:
                if node is not None:
                    done["depth"].append(node[0]); done["key_q"].append(node[1]); done["ends_sha256"].append(digest.hexdigest())
                node, digest, first = (int(d), int(kq)), hashlib.sha256(), True
            digest.update((("" if first else ",") + str(int(conv))).encode())
            first = False
        if len(done["depth"]) >= 50_000:
            yield pd.DataFrame(done)
            done = {name: [] for name in done}
    if node is not None:
        done["depth"].append(node[0]); done["key_q"].append(node[1]); done["ends_sha256"].append(digest.hexdigest())
    if done["depth"]:
        yield pd.DataFrame(done)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``NODES``.

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's (null
    at the root); ``n_leaves`` counts childless nodes of the subtree, the node
    included; ``saved_tokens`` sums, over the subtree, each node's
    (n_convs - 1) times the UTF-8 bytes of its last text; ``ends_sha256`` hashes
    the comma-joined conv_ids, ascending, of the members with exactly ``depth``
    turns (the empty string's hash if none).
    """
    spark = conversations.sparkSession
    shared_folder(spark)  # checkpoints go to the shared folder
    parts = max(1, -(-conversations.count() // TURNS_PER_PARTITION))
    ordered = (
        rebuilt(conversations)
        .repartitionByRange(parts, "keys", "conv_id")
        .sortWithinPartitions("keys", "conv_id")
        .checkpoint()
    )
    ordered = ordered.withColumn("pid", F.spark_partition_id())
    rows = ordered.mapInPandas(_borders, BORDERS).collect()  # one row per partition
    borders = spark.sparkContext.broadcast(border_table(rows))
    at = fresh_folder(spark, "trie-pieces")
    ordered.mapInPandas(_pieces(borders), PIECES).write.parquet(at)
    pieces = spark.read.parquet(at)

    nodes = pieces.filter("conv_end IS NULL").groupBy("depth", "key_q", "key_a").agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("children").alias("n_children"),
        F.sum("leaves").alias("n_leaves"),
        F.sum("shared").alias("shared"),
        F.max("head_bytes").alias("head_bytes"),
        F.max("parent_q").alias("parent_q"),
        F.max("parent_a").alias("parent_a"),
        F.max("ends_sha256").alias("closed_ends"),
    )
    ends_at = fresh_folder(spark, "trie-ends")
    (
        pieces.filter("conv_end IS NOT NULL")
        .select("depth", "key_q", "conv_end")
        .repartition("depth", "key_q")
        .sortWithinPartitions("depth", "key_q", "conv_end")
        .mapInPandas(_stream_ends, "depth long, key_q long, ends_sha256 string")
        .write.parquet(ends_at)
    )
    ends = spark.read.parquet(ends_at).withColumn("key_a", F.lit(-1).cast("long"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("key_q").alias("parent_q"), F.col("key_a").alias("parent_a"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    whole = nodes.join(ends, ["depth", "key_q", "key_a"], "left").join(parents, ["depth", "parent_q", "parent_a"], "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("shared") - (F.col("n_convs") - 1) * F.col("head_bytes")).alias("saved_tokens"),
        F.coalesce("closed_ends", "ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
