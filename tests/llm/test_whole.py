"""Findings of the second review: the whole job, on cases that were left out before."""

import random

from columnary.llm import decontam, linededup, secret_scan
from columnary.llm.queries import LLM_QUERIES

SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, band string, label long"


def later_lines(texts):
    """(id, start, end) of every line that an earlier document, or place, holds too; plain Python."""
    seen, out = set(), set()
    for i in sorted(texts):
        at = 0
        for line in (texts[i] or "").split("\n"):
            key = " ".join(line.lower().split())
            if key in seen:
                out.add((i, at + len(line) - len(line.lstrip()), at + len(line.rstrip())))
            if key:
                seen.add(key)
            at += len(line) + 1
    return out


def test_every_later_line_goes_whatever_its_length(spark):
    rng = random.Random(3)
    common = ["Of.", "All rights kept.", "a short line that all of them have", " ".join(f"c{k}" for k in range(40))]
    texts = {}
    for i in range(30):
        lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 40))) for _ in range(4)]
        for c in rng.sample(common, 2):
            lines.insert(rng.randrange(len(lines) + 1), f"  {c.upper()} " if i % 2 else c)
        texts[i] = "\n".join(lines)
    texts |= {40: "one line\nnext line\none line", 41: None, 42: texts[3]}
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in texts.items()], DOCS)
    spans = linededup.repeated_spans(docs, whole_lines=True).collect()
    want = later_lines(texts)
    for i, start, end in want:
        assert any(s["doc_id"] == i and s["start"] <= start and end <= s["end"] for s in spans), texts[i][start:end]
    for s in spans:
        inside = [(a, b) for i, a, b in want if i == s["doc_id"] and s["start"] <= a and b <= s["end"]]
        assert s["start"] == min(inside)[0] and s["end"] == max(b for _, b in inside)
        assert s["n_words"] == len(texts[s["doc_id"]][s["start"]:s["end"]].split()) and s["n_units"] == len(inside)
    left = {r["doc_id"]: r["text"] for r in linededup.without_repeats(docs, whole_lines=True).collect()}
    assert sum(t.lower().count("a short line") for t in left.values() if t) == 1 and left[42].strip() == ""


def test_later_lines_of_the_given_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    spans = {}
    for s in LLM_QUERIES["op8_line_dedup"](spark, SMALL).collect():
        spans.setdefault(s["doc_id"], []).append((s["start"], s["end"]))
    missed = [x for x in later_lines(texts) if not any(a <= x[1] and x[2] <= b for a, b in spans.get(x[0], []))]
    assert not missed


def kinds_of(spark, items, texts, **asked):
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.contaminated(docs, bench, **asked).collect()}


def test_numbers_need_no_renaming_and_every_alignment_is_judged(spark):
    item = "so Anna buys 2 apples for 2 dollars in the shop and then Bert sells 3 pears to the old man at the gate for 4 coins"
    other = item.replace("2 apples for 2", "3 apples for 5").replace("3 pears", "9 pears").replace("for 4", "for 9")
    mixed = item.replace("Bert", "Anna")
    texts = [other, mixed, f"{mixed} and {item}", f"{item} and {mixed}", "nothing of the kind stands in here at all"]
    want = {(0, 0): "reparameterised", (2, 0): "verbatim", (3, 0): "verbatim"}
    assert kinds_of(spark, [item], texts) == want
    assert kinds_of(spark, [item], texts, inconsistent=True) == want | {(1, 0): "inconsistent"}


def test_other_units_are_other_values(spark):
    item = "we paid 3 euros to the old man at the gate and he gave us 5 kg of ripe pears from his garden"
    texts = [item, item.replace("euros", "dollars"), item.replace("kg", "lbs").replace("3", "4"), ""]
    assert kinds_of(spark, [item], texts) == {(0, 0): "verbatim", (1, 0): "reparameterised", (2, 0): "reparameterised"}


def test_names_at_sentence_starts_and_reprints(spark):
    item = "Natalia sold clips to 48 of her friends. Natalia then sold half as many"
    other = "That is so because Tom and his old friend went to the large market by the river"
    texts = [
        "Maria sold clips to 12 of her friends. Maria then sold half as many", f"we read here\n{item}", item.lower(),
        f"one line without a stop\n{other.replace('Tom', 'Jim')} today", other.lower(), "Natalia sold her house. Then she left for good and all",
    ]
    want = {(0, 0): "reparameterised", (1, 0): "verbatim", (2, 0): "verbatim", (3, 1): "reparameterised", (4, 1): "verbatim"}
    assert kinds_of(spark, [item, other], texts) == want


def test_short_and_numeric_items_inside_longer_documents(spark):
    items = ["12 + 35 - 7 = ?", "1 2 3 4 5 6", "name three primes", "7 + 8", "Which 3 rivers meet"]
    texts = [
        "the task was 12 + 35 - 7 = ? and nobody knew", "count 1 2 3 4 5 6 now please", "please name three primes below ten today", "Which 9 rivers meet here by the town",
        "count 1 2 3 9 5 6 now please", "the task was 12 + 36 - 7 = ? and nobody knew", "1 2", "7 8",
    ]
    want = {(0, 0): "verbatim", (1, 1): "verbatim", (2, 2): "verbatim", (3, 4): "reparameterised", (7, 3): "verbatim"}
    assert kinds_of(spark, items, texts) == want


def test_hex_and_endpoints_complete_a_link(spark):
    key, long_hex, at = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12", "0123456789abcdef" * 4, "https://db.example.org/x"
    cases = [
        (f"client_id=alice77 next to {long_hex}", ["ident", "hex"]), (f"{key} at {at}", ["key", "endpoint"]), (f"user: alice at {at}", ["ident", "endpoint"]),
        (f"{long_hex} at {at}", ["hex", "endpoint"]), (f"only {at}", []), (f"user: alice{' word' * 200} {long_hex}", ["hex"]),
    ]
    docs = spark.createDataFrame([(i, t, "b", 1) for i, (t, _) in enumerate(cases)], DOCS)
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secret_scan.scan(docs, any_two=True).collect()}
    assert got == {i: kinds for i, (_, kinds) in enumerate(cases)}


def test_hex_is_a_secret_by_default_too(spark):
    docs = spark.createDataFrame([(0, "account_id: bob99 and " + "ab" * 20, "b", 1)], DOCS)
    assert [s["kind"] for s in secret_scan.scan(docs).first()["spans"]] == ["ident", "hex"]
