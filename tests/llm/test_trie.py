"""Prefix trie against a plain dictionary trie; parentheses against a stack."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from columnary.llm import conversation_trie as ct


def rebuilt(rows, share=20):
    """conv_id to its rebuilt turns (role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(said)] for c, said in own.items()}
    out = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % share, [])[:h] + said[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    count = lambda p: len(p[-1][1].split()) if p else 0
    rows = []
    for p, who in members.items():
        leaves = saved = 0
        waiting = [p]
        while waiting:
            q = waiting.pop()
            leaves += q not in children
            saved += (len(members[q]) - 1) * count(q)
            waiting += children.get(q, [])
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        rows.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: (r[0], r[1]))


def got(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    done = ct.trie(ct.branched(ct.turn_lists(df)))
    return sorted((tuple(r) for r in done.collect()), key=lambda r: (r[0], r[1]))


def test_find_close_is_a_stack():
    rng = random.Random(3)
    for n in (1, 2, 31, 32, 33, 500, 5000):
        bits, depth, left = [1], 1, n - 1
        while depth:
            if left and (depth == 1 or rng.random() < 0.5):
                bits.append(1)
                depth, left = depth + 1, left - 1
            elif left == 0 or depth > 1:
                bits.append(0)
                depth -= 1
        stack, want = [], {}
        for j, b in enumerate(bits):
            if b:
                stack.append(j)
            else:
                want[stack.pop()] = j
        assert ct.find_close(np.asarray(bits, bool)).tolist() == [want[i] for i in sorted(want)]
    deep = np.asarray([1] * 3000 + [0] * 3000, bool)
    assert ct.find_close(deep).tolist() == list(range(5999, 2999, -1))


def made(seed, convs=300):
    """Conversations with common beginnings, equal ones, one that ends inside others and a hot one."""
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        n = rng.choice([1, 2, 2, 3, 5, 9])
        for t in range(n):
            text = "hot start" if c % 3 == 0 and t < 2 else rng.choice(["a b c", "d e", " ", "", None, "long " * 50]) if t < 3 else rng.choice(["x y", f"own {rng.randrange(40)}"])
            rows.append((c, t if rng.random() < 0.97 else None, rng.choice(["user", "assistant"]) if t else "user", text))
    return rows


@pytest.mark.parametrize("shard,fewest", [(20_000, 64), (40, 12), (7, 6)])
def test_trie_is_the_plain_one(spark, monkeypatch, shard, fewest):
    """Whole in one shard, and handed on over many shards and rounds."""
    rows = made(shard)
    monkeypatch.setattr(ct, "SHARD", shard)
    monkeypatch.setattr(ct, "FEWEST_PATHS", fewest)
    assert got(spark, rows) == plain_trie(rebuilt(rows))


def test_defined_cases(spark):
    rows = [
        (None, 0, "user", "lost"), (0, 0, "user", "hi"), (0, 0, "user", "hi"), (0, None, None, None),
        (7, 1, "user", "only"), (45, 0, "a", "b c"), (45, 1, "", None), (46, 0, "ab", " c"), (21, 0, "user", "alone"),
    ]
    assert got(spark, rows) == plain_trie(rebuilt(rows))
    assert got(spark, []) == []
    clash = spark.createDataFrame([(1, 0, "u", "t", 5, "p")], "conv_id long, turn int, role string, text string, said int, path string")
    assert ct.trie(ct.turn_lists(clash)).count() == 2


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(ct, "SHARD", 100)
    monkeypatch.setattr(ct, "FEWEST_PATHS", 6)
    rows = [(c, t, "user", f"t {t}") for c, n in [(60, 400), (61, 390), (62, 5), *((c, 300) for c in range(80, 100))] for t in range(n)]
    assert got(spark, rows) == plain_trie(rebuilt(rows))


def test_end_digests_stream(spark):
    ends = spark.range(5000).selectExpr("cast('k' as binary) AS key", "id AS conv_id")
    want = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert [r.ends for r in ct.end_digests(ends).collect()] == [want]
