"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from flowsift.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, total int, chain string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, role, digest), (role, text)))
    turns = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = turns.get(base, [])[:h] + mine[h:]
    return out


def plain(convs):
    nodes = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].add(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
    return sorted((
        min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest(),
    ) for p, m in nodes.items())


def run(spark, rows, width=trie.WIDTH, heads=True):
    runs, convs = trie.ordered_turns(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3))
    if heads:
        runs, convs = trie.with_shared_heads(runs, convs)
    return sorted(tuple(-1 if x is None else x for x in r) for r in trie.prefix_trie(runs, convs, width).collect())


def conversations(seed, many, deep):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, many):
        for t in range(rng.choice([1, 2, 3, rng.randint(0, deep)])):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "ü" * 3, None])))
    rows += [(3, None, "user", "first"), (3, 1, "bot", "tie"), (3, 1, "bot", "tie"), (3, 1, "abc", "tie"), (None, 1, "user", "lost"), (4, 2, "user", "w " * 5000)]
    rows += [(1000 + k, t, "user", f"same {t}") for k in range(40) for t in range(5)]  # copies
    return rows


@pytest.mark.parametrize(("width", "batch"), [(trie.WIDTH, 10_000), (trie.WIDTH, 7), (2, 5), (3, 10_000)])
def test_all_prefixes(spark, width, batch):
    """Also with blocks of a few rows, and with rows of a few turns, so that nodes reach over blocks and levels."""
    rows = conversations(width + batch, 60, 12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert run(spark, rows, width) == plain(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_one_conversation_with_most_rows(spark):
    rows = [(5, t, "user", f"t{t // 2}") for t in range(300)] + [(6, t, "user", f"t{t // 2}") for t in range(90)] + [(7, 0, "user", "x")]
    rows += [(8, 0, "user", "again")] * 200
    assert run(spark, rows, 16, heads=False) == plain({c: [("user", x[3]) for x in rows if x[0] == c] for c in (5, 6, 7, 8)})


def test_no_turns(spark):
    assert run(spark, [(None, 1, "user", "x")]) == []
    rows = [(1, 0, "user", "gone")]  # its head is longer than the conversation, and there is nothing to take it from
    assert zlib.crc32(b"1") % 9 >= 1
    assert run(spark, rows) == plain({1: []}) == [(1, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
