"""The prefix trie against a plain one in memory."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from parley.llm import trie

KIND = "conv_id long, turn long, role string, text string, depth string, key string"


def plain_trie(rows):
    turns, nodes, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            turns[conv_id].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        return [p, *(x for child in children.get(p, []) for x in below(child))]

    found = []
    for p, members in nodes.items():
        sub = below(p)
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in sub if x)
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(p))
        found.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])), sum(x not in children for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def some_rows(seed):
    rng = random.Random(seed)
    rows = [
        (c, rng.choice([t, t, None]), rng.choice(["user", None, "a"]), rng.choice(["x", "xy", None, "é", "𝒳 long text"][: rng.choice([1, 2, 5])]))
        for c in [*rng.sample(range(-150, 900), 120), 0, 200]
        for t in range(rng.choice([1, 1, 2, 3, 8, 12]))
    ]
    rows += [(None, 1, "a", "b"), *rows[:3]]  # no conversation; rows that repeat
    if seed:  # a third of all conversations alike, and a long one
        rows += [(c, t, "user", "hot") for c in range(1000, 1150) for t in range(7)]
        rows += [(c, t, "user", "hot") for c in (990, 1200) for t in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_trie_equals_plain_version(spark, seed):
    rows = some_rows(seed)
    spark.conf.set("spark.sql.shuffle.partitions", "7" if seed == 2 else "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false" if seed else "true")
    try:
        found = trie.prefix_trie(spark, spark.createDataFrame([(*r, "x", "y") for r in rows], KIND), chunk=5 if seed else trie.CHUNK).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, found), key=str) == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie.prefix_trie(spark, spark.createDataFrame([], KIND)).collect() == []
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # its hundred has no first, and it has one turn
    found = trie.prefix_trie(spark, spark.createDataFrame([(c, 0, "user", "gone", "x", "y")], KIND)).collect()
    assert [tuple(r) for r in found] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_shared_depth():
    rng = random.Random(1)
    turns = [bytes([i]) * trie.DIGEST for i in range(3)]
    for _ in range(300):
        a, b = ([rng.choice(turns) for _ in range(rng.randrange(6))] for _ in "ab")
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert trie.shared_depth(b"".join(a), b"".join(b)) == n
