"""Filter audit and Jaccard join against brute force."""

import random
from itertools import permutations

from columnary.llm import filter_audit, jaccard_join
from pyspark.sql import functions as F


def plain_audit(docs, labels):
    """Every order applied to every document, one by one."""
    marks = {}
    for i, q, t in labels:
        a, b = marks.get(i, (False, False))
        marks[i] = (a or q == 1, b or t == 1)
    fails = []
    for i, text, lang in docs:
        text = text or ""
        ws = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        fails.append({
            "A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        })
    rows = {}
    for part in {lang or "" for _, _, lang in docs}:
        mine = [(f, marks.get(d[0], (False, False)) if d[0] is not None else (False, False)) for f, d in zip(fails, docs) if (d[2] or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = list(mine), []
            for step, x in enumerate(order, 1):
                lost = [m for m in left if m[0][x]]
                left = [m for m in left if not m[0][x]]
                rows[part, "".join(order), step] = [len(left), len(lost), sum(m[0][x] for m in gone), sum(m[0][x] and sum(m[0].values()) == 1 for m in mine), sum(m[1][0] for m in lost), sum(m[1][1] for m in lost)]
                gone += lost
                shares[x] += len(lost)
        for (p, order, step), r in rows.items():
            if p == part:
                r.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in rows.items()}


def test_audit_is_the_plain_one(spark):
    rng = random.Random(5)
    texts = [None, "", "short one", "AB cd " * 60, "#x " + " ".join(f"w{i}" for i in range(120)), " ".join(f"v{i}" for i in range(150)), "same same\tword\n" * 50, "x" * 5000]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["de", "en", None, ""])) for _ in range(80)]
    labels = [(rng.choice([None, *range(45)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(60)]
    df = spark.createDataFrame([(*d, "mine", 3) for d in docs], "doc_id long, text string, lang string, digest string, mask int")
    marks = spark.createDataFrame([(*x, "de") for x in labels], "doc_id long, quality int, toxic int, lang string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(df, marks).collect()}
    assert got == plain_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), marks).count() == 0


def test_audit_with_own_filters(spark):
    df = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "x", 1), (3, "b", None, 9)], "doc_id long, text string, lang string, size int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(df, none, {"S": F.col("size") > 4}).collect()
    assert {(r.part, r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in rows} == {
        ("x", "SE", 1, 1, 1, 2), ("x", "SE", 2, 0, 1, 2), ("x", "ES", 1, 1, 1, 2), ("x", "ES", 2, 0, 1, 2),
        ("", "SE", 1, 0, 1, 2), ("", "SE", 2, 0, 0, 0), ("", "ES", 1, 1, 0, 0), ("", "ES", 2, 0, 1, 2)}


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws)} - {()} if len(ws) < 3 else {tuple(ws[i:i + 3]) for i in range(len(ws) - 2)}


def plain_join(docs):
    """Component of every row position by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                top[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return sorted(out, key=repr)


def joined(spark, docs):
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n long, token long")
    return sorted((tuple(r) for r in jaccard_join.jaccard_join(df).collect()), key=repr)


def test_join_is_the_plain_one(spark):
    """Groups around the threshold, chains, shared passages, short and long texts."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(60)]
    docs = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 12, 40, 150, 600]))]
        for _ in range(rng.choice([1, 3, 14])):
            text = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                text[rng.randrange(len(text))] = word()
            base = text if rng.random() < 0.3 else base
            docs.append((len(docs), " ".join(text)))
    docs += [(len(docs) + i, " ".join(passage + [word() for _ in range(rng.choice([4, 30]))])) for i in range(20)]
    docs += [(900, "one"), (901, "ONE"), (902, "one two"), (903, "Two one"), (904, None), (905, " \t"), (906, ""), (5, "a b c d"), (5, "e f g h"), (None, "a b c d"), (None, "q r s t")]
    rng.shuffle(docs)
    assert joined(spark, docs) == plain_join(docs)
    assert joined(spark, []) == []


def test_join_of_a_large_group_near_the_threshold(spark):
    """Many copies of one text with edits of their own, on both sides of the threshold."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randrange(9)):
            text[rng.randrange(200)] = f"own{rng.randrange(500)}"
        docs.append((i, " ".join(text)))
    assert joined(spark, docs) == plain_join(docs)


def test_join_drops_half_shared_texts_before_their_shingles_are_listed(spark):
    """Texts that have half of their shingles in common go by the longer prefix; linked ones stay, of any size."""
    import numpy as np

    rng = random.Random(5)

    def words(k: int) -> list[str]:
        return [f"w{rng.randrange(10**9)}" for _ in range(k)]

    pool = [words(40) for _ in range(4)]
    half = [[*sum((w for piece in rng.sample(pool, 2) for w in (words(45), piece)), []), *words(10)] for _ in range(40)]
    near = []
    for size in (3, 12, 40, 41, 97, 200, 333):
        base = words(size)
        near += [base, [*base[: size - size // 25], *words(size // 25)]]
    rows = [(i, " ".join(t)) for i, t in enumerate([*half, *near])]
    sets = [jaccard_join.shingle_set(t, jaccard_join.WIDTH) for _, t in rows]
    lists = [(i, len(s), *[jaccard_join.hashed_prefix(s, jaccard_join.ORDERS[1], e).view(np.int64).tolist() for e in (20, 8)]) for i, s in enumerate(sets)]
    classes = spark.createDataFrame(lists, "cid long, n long, short array<long>, longer array<long>")
    linked = {i for i, s in enumerate(sets) for j, o in enumerate(sets) if i != j and 100 * len(np.intersect1d(s, o)) >= 90 * len(np.union1d(s, o))}
    short, longer = ({r.cid for r in jaccard_join._met(classes, *how).collect()} for how in (("short",), ("longer", 8)))
    assert len(linked) >= 8 and linked <= longer and linked <= short
    assert sum(i < 40 for i in longer) < sum(i < 40 for i in short) / 2
    found = dict(jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect())
    assert {i for i in found if list(found.values()).count(found[i]) > 1} == linked
