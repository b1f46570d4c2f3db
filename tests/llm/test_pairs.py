"""Near duplicates, decontamination, fingerprints and line hashing against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from columnary.llm import decontam, fingerprints, linededup, neardup, shingles

DOCS = "doc_id long, text string, band string, label long"


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_sets(text):
    w = word_list(text)
    return {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """Bases, copies with growing edits, exact copies, a shared passage, short, empty, null and repeated texts."""
    rng = random.Random(seed)
    passage = prose(rng, 60, 10_000)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(40, 160), 10_000)
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 4, 5, 6, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    for _ in range(25):
        own = prose(rng, 50, 10_000)
        texts.append(" ".join(own[:20] + passage + own[20:]))
    texts += ["", None, "  \n", "one two", "One  two", "a b c d", "A b c d e", "a b c d e", "x " * 5_000, "tail\x0bof words here now ok", "tail of\twords here now OK"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return dict(zip(ids, texts))


def brute_components(texts):
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingle_sets(t) for i, t in texts.items()}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in texts.items()], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(texts)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, _, k) in got.items() if k}


def test_near_duplicates_corner_rows(spark):
    same = "one two three four five six seven"
    rows = [(None, same, None, None), (5, same, None, None), (3, same, None, None), (3, same, None, None), (3, "another text of quite other words", None, None), (9, None, None, None), (9, None, None, None)]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter({(None, 3, True): 1, (5, 3, False): 1, (3, 3, True): 3, (9, 9, True): 2})
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_exact_rest_join_finds_what_stars_miss(spark):
    rng = random.Random(4)
    base = prose(rng, 120, 10_000)
    texts = {i: " ".join(base[:k] + [f"z{i}"] + base[k + 1:]) for i, k in enumerate(rng.sample(range(120), 30))}
    texts |= {100 + i: " ".join(prose(rng, 40, 10_000) + base[:30]) for i in range(20)}
    key = {i: neardup._digest(shingles.shingle_set(t)) for i, t in texts.items()}
    members = spark.createDataFrame([(key[i], key[i]) for i in texts], "class_key binary, label binary")
    held = spark.createDataFrame([(key[i], t) for i, t in texts.items()], "class_key binary, text string")
    spark.sparkContext.setCheckpointDir("/tmp/columnary-llm-tests")
    pairs = {(bytes(r["a"]), bytes(r["b"])) for r in neardup._rest_pairs(members, held).collect()}
    sets = {i: shingle_sets(t) for i, t in texts.items()}
    must = {tuple(sorted((key[a], key[b]))) for a in texts for b in texts if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert must and must <= pairs


def test_sketch_fills_every_coordinate_and_estimates(spark):
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    sketches = shingles.similarity_sketch([a, b, a[:1], a[:0], a[:3]], 210)
    assert (sketches[[0, 1, 2, 4]] != 2**64 - 1).all() and (sketches[3] == 2**64 - 1).all()
    assert abs((sketches[0] == sketches[1]).mean() - 300 / 500) < 0.15


ITEM = "Tom Miller buys 12 green apples and Anna sells 7 red pears for 3.5 dollars each day in the small town market"


@pytest.mark.parametrize("text, kind", [
    (f"some words before Then {ITEM} and some after", "verbatim"),
    ("Well then Rob Fisher buys 99 green apples and Lena sells 4 red pears for 18 dollars each day in the small town market ok", "reparameterised"),
    ("Well then Rob Rob buys 99 green apples and Rob sells 99 red pears for 18 dollars each day in the small town market ok", None),
    ("nothing of the kind in here at all", None),
    (ITEM[: len(ITEM) // 2], None),
    (None, None),
    ("", None),
])
def test_decontamination_by_template(spark, text, kind):
    items = spark.createDataFrame([(1, "so " + ITEM, "t"), (2, None, "t"), (3, "", "t"), (4, "1 2 3 4 5 6", "t")], "item_id long, text string, kind string")
    docs = spark.createDataFrame([(10, text, "b", 1), (10, text, "b", 1), (None, text, "b", 1), (11, "a clean text that shares only the small town market", "b", 1)], DOCS)
    got = [(r["doc_id"], r["item_id"], r["kind"]) for r in decontam.contaminated(docs, items).collect()]
    assert sorted(got, key=repr) == (sorted([(10, 1, kind), (None, 1, kind)], key=repr) if kind else [])
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == ([11] if kind else [0, 10, 10, 11])


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    items = {k: " ".join(prose(rng, rng.randint(6, 40), 60)) for k in range(15)}
    texts = {}
    for i in range(120):
        own = prose(rng, 80, 60)
        if i % 3 == 0:
            w = items[rng.randrange(15)].split()
            cut_at = rng.choice([0, 0, 1, 2, len(w) // 3])
            own[rng.randrange(80):0] = w[cut_at:]
        texts[i] = " ".join(own)

    def windows(t):
        w = t.lower().split()
        return {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    want = {(i, k) for i, t in texts.items() for k, q in items.items() if windows(q) and len(windows(t) & windows(q)) >= 0.75 * len(windows(q))}
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in texts.items()], DOCS)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()} == want and want
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_fingerprints_estimate_and_edit(spark):
    rng = random.Random(6)
    texts = {i: " ".join(prose(rng, rng.choice([0, 1, 3, 4, 5, 30, 200, 900]), 10_000)) for i in range(60)} | {60: None, 61: "", 62: "é😀 " * 30}
    texts[63], texts[64] = texts[7], texts[7]
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in texts.items()], DOCS)
    got = {r["doc_id"]: r for r in fingerprints.compared(docs).select("*", fingerprints.as_text("own").alias("print")).collect()}
    order = sorted(texts, reverse=True)
    import hashlib

    errors = []
    for k, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
        for other, near in ((edited, "near_edited"), (after, "near_next")):
            a, b = shingle_sets(t), shingle_sets(other)
            errors.append(got[i][near] - (len(a & b) / len(a | b) if a | b else 1.0))
            if max(len(a), len(b)) < fingerprints.LEAST:
                assert errors[-1] == 0
    assert np.abs(errors).mean() < 0.05
    assert got[7]["print"] == got[63]["print"] == got[64]["print"]


def test_fingerprint_corner_rows(spark):
    rows = [(1, "a b c d e f", "b", 1), (1, "a b c d e f", "b", 1), (None, "g h i j k l", "b", 1)]
    got = fingerprints.compared(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 1]
    alone = fingerprints.compared(spark.createDataFrame(rows[:1], DOCS)).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert fingerprints.compared(spark.createDataFrame([], DOCS)).collect() == []


def brute_spans(texts):
    """The rule of the docstring in plain Python over (id, text)."""
    first, units = {}, {}
    for i in sorted(texts):
        units[i] = list(linededup.split_units(texts[i]))
        for start, _, _, digest in units[i]:
            first.setdefault(digest, (i, start))
    out = set()
    for i, us in units.items():
        run = []
        for u in [*us, None]:
            if u and first[u[3]] != (i, u[0]):
                run.append(u)
                continue
            if run and sum(x[2] for x in run) >= linededup.RUN_WORDS:
                out.add((i, run[0][0], run[-1][1], len(run), sum(x[2] for x in run), *first[run[0][3]]))
            run = []
    return out


def test_line_dedup_catches_passages_inside_lines(spark):
    rng = random.Random(9)

    def sentences(n):
        out = []
        while n > 0:
            k = rng.randint(4, 14)
            out.append(" ".join(prose(rng, k, 10_000)).capitalize() + ".")
            n -= k
        return " ".join(out)

    passage, texts = sentences(70), {}
    for i in range(40):
        own = "\n".join(sentences(40) for _ in range(3)).split(" ")
        if i % 4 == 0:
            own.insert(rng.randrange(len(own)), passage)
        texts[i] = " ".join(own) + "\nA short line that all have."
    texts |= {50: texts[3], 51: None, 52: "", 53: "same again and again here. " * 20, 54: "  lead and  tail   spaces in a rather long sentence that has no stop at all and goes on and on for more than thirty words so that it is cut at anchors inside \n next", 55: ""}
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in texts.items()], DOCS)
    got = {tuple(r) for r in linededup.repeated_spans(docs).collect()}
    assert got == brute_spans(texts)
    flagged = {g[0] for g in got}
    assert flagged == {4 * k for k in range(1, 10)} | {50, 53}
    cleaned = {r["doc_id"]: r for r in linededup.without_repeats(docs).collect()}
    assert cleaned[1]["text"] == texts[1] and cleaned[1]["removed"] is None
    middle = passage.split(". ")[3]
    assert middle in cleaned[0]["text"] and middle not in cleaned[8]["text"]
    assert linededup.repeated_spans(docs.limit(0)).count() == 0


def test_line_dedup_null_and_repeated_ids(spark):
    text = "One two three four five six seven eight nine ten eleven twelve. Thirteen and more words follow here until there are thirty of them in all, which is now surely so, one hopes. And a third sentence of nine plain words here."
    docs = spark.createDataFrame([(1, text, "b", 1), (1, text, "b", 1), (None, text, "b", 1)], DOCS)
    assert {(r["doc_id"], r["kept_doc_id"]) for r in linededup.repeated_spans(docs).collect()} == {(None, 1)}
    assert docs.select(F.count("*")).first()[0] == 3
