"""Conversation prefix trie against a brute-force version, over many partitions."""

import random

import hashlib, zlib
from collections import defaultdict

def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is None: continue
        r, x = r or "", x or ""
        convs[c].append(((t is not None, t if t is not None else 0, r, x), (r, x)))
    turns = {c: [v for _, v in sorted(ts)] for c, ts in convs.items()}
    seqs = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        b = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        base = turns.get(b, [])
        seqs[c] = tuple(base[:h]) + tuple(turns[c][h:])
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p: children[p[:-1]].append(p)
    def sub(p):
        yield p
        for ch in children[p]:
            yield from sub(ch)
    out = []
    for p, members in nodes.items():
        d = len(p)
        st = list(sub(p))
        leaves = sum(1 for y in st if not children[y])
        saved = sum((len(nodes[y]) - 1) * (len(y[-1][1].encode()) if y else 0) for y in st)
        ends = sorted(c for c in members if len(seqs[c]) == d)
        out.append((min(members), d, min(nodes[p[:-1]]) if d else None, len(members), len(children[p]), leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def conversations():
    pick = random.Random(5)
    words = ["hi", "hello", "yes", "no", "", None, "é😀", "long " * 50]
    rows = []
    common = [("user", "same start"), ("assistant", "same answer"), ("user", "again")]
    for c in range(0, 400):
        if c % 3 == 0:
            turns = common[: 1 + c % 3]
        else:
            turns = [(pick.choice(["user", "assistant", None]), pick.choice(words)) for _ in range(pick.randint(0, 6))]
        for t, (role, text) in enumerate(turns):
            rows.append((c, t if c % 17 else None, role, text, "x", 1))
    rows += [(5, 0, "user", "repeated"), (5, 0, "user", "repeated"), (None, 0, "user", "no id"), (401, None, None, None)]
    return [r if len(r) == 6 else r + ("y", 2) for r in rows]


def test_against_brute_force(spark, monkeypatch):
    from tallymart.llm import prefix_trie

    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string, n_convs long")
    want = brute([r[:4] for r in rows])
    for per_partition in (7, 60, 100_000):
        monkeypatch.setattr(prefix_trie, "TURNS_PER_PARTITION", per_partition)
        have = sorted((tuple(r) for r in prefix_trie.trie(frame).collect()), key=lambda r: (r[0], r[1]))
        assert have == want


def test_empty_table(spark):
    from tallymart.llm import prefix_trie

    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(frame).count() == 0
