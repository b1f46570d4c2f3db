"""Packing: first-fit decreasing in randomised groups of documents.

Documents become token ids, ids are cut into pieces of at most one sequence,
and each group of pieces (dealt by a hash, so no key can make one large) is
packed on its own: pieces by falling length, each into the leftmost sequence
with room, found in a tournament tree of remaining capacities.

Defined cases: null text is empty text and holds the end id alone; repeated
rows are packed each on its own; a null id is kept; an empty table gives an
empty one; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, ship, take_worker

#: Id that ends every document.
END_ID = 1
#: Pieces whose group is expected to hold about so many documents.
GROUP_DOCS = 1024
#: Chunks of a cache generation; a Python worker keeps at most two generations.
GENERATION = 1_000_000
#: Texts with other signs than these are encoded chunk by chunk: these are kept by the
#: normalizer, apart from their case, and each is a letter, a digit, a space or none of them, whatever stands beside it.
_OTHER = re.compile("[^\x00-\x7f¡«»¿À-ÖØ-öø-ÿ–—‘’“”…€]")
_WORD = re.compile("[a-zß-öø-ÿ]+")
#: What this tokenizer's pattern cuts a lower-case text of those signs into.
_TOKENS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9ß-öø-ÿ \t-\r]+")

_LOADED: dict[str, _Chunks] = {}
keeps("packing", _LOADED.clear)


class _Chunks(dict):
    """Ids of chunks of texts as bytes; a chunk not met yet is encoded when it is asked for.

    When the young generation is full it becomes the old one, and chunks still
    in use move back: the cache is bounded and keeps what repeats.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word, self.old = self.tokenizer.model.tokenize, {}
        # letters as the model knows them
        self.spelt = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if _WORD.match(c)}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            core, tail = _core(chunk)
            if tail:
                ids = self[core] + self[tail]
            elif _WORD.fullmatch(core):  # one word to the model
                ids = array("I", [t.id for t in self.word(core if core.isascii() else core.translate(self.spelt))]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = ids
        return ids

    def renew(self) -> None:
        self.old = dict(self)
        self.clear()


def _chunks(path: str) -> _Chunks:
    if path not in _LOADED:
        _LOADED[path] = _Chunks(path)
    return _LOADED[path]


def _core(chunk: str) -> tuple[str, str]:
    """A chunk as two parts whose ids follow each other: letters end before a
    mark in this tokenizer, and ASCII letters have the ids of their lower case."""
    tail = chunk[-1:]
    core = chunk[:-1]
    if tail not in (",", ".") or not (core.isalpha() and core.lower().isalpha()):
        core, tail = chunk, ""
    return (core.lower() if core.isascii() and core.isalpha() else core), tail


def _split(body: str) -> list[str]:
    """Parts whose ids follow each other: tokens before the model sees them, or chunks between spaces and
    line feeds, which separate tokens in this tokenizer and leave none."""
    # special tokens are told by case, all other signs of these are not
    if "<|" in body or not body.isascii() and _OTHER.search(body):
        return body.replace("\n", " ").split(" ")
    return _TOKENS.findall(body.lower())


def _encoded(texts: list[str | None], path: str, cache: int = GENERATION) -> Iterator[bytes]:
    """Little-endian unsigned 32-bit ids of each text, without the end id; chunks repeat and are encoded once."""
    known = _chunks(path)
    for text in texts:
        if len(known) > cache:
            known.renew()
        yield b"".join(map(known.__getitem__, _split(text or "")))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", cache: int = GENERATION) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, ids``; ``ids`` is the binary
    of little-endian unsigned 32-bit ids. Every document ends with ``END_ID``. ``cache`` trades a
    worker's memory for time, not the result."""
    ship(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("packing")
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            rows, start, length, total, ids, held = [], [], [], [], [], 0
            for i, body in enumerate(_encoded(texts, tokenizer_path, cache)):
                body += end
                n = len(body) // 4
                for s in range(0, n, capacity):
                    part = body[4 * s:4 * (s + capacity)]
                    rows.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    total.append(n)
                    ids.append(part)
                    held += len(part)
                if held > 8_000_000 or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "length", "doc_tokens", "ids"],
                    )
                    rows, start, length, total, ids, held = [], [], [], [], [], 0

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(cut_up, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length; bins are numbered in order of opening.

    The tree holds the largest remaining capacity below each node; the way to
    the leftmost bin with room turns left wherever the left side has enough.
    """
    n = len(lengths)
    size = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * size)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            largest = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == largest:
                break
            tree[node] = largest
    return bins, offsets


def pack(pieces: DataFrame, n_docs: int, capacity: int = 2048, group_docs: int = GROUP_DOCS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; further columns are kept.

    ``n_docs`` sizes the groups; a group's number is the upper half of its
    sequence ids.
    """
    ship(pieces.sparkSession)
    groups = max(1, -(-n_docs // group_docs))
    keyed = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", F.lit(20_011)), F.lit(groups)))
    out = pieces.schema.add("sequence_id", "long").add("offset", "long")
    order = [c for c in ("length", "doc_id", "start") if c in pieces.columns]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, ascending=[False, True, True][: len(order)], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(np.int64), capacity)
        sequence = (group["pack_group"].to_numpy(np.int64) << 32) + bins
        return group.drop(columns="pack_group").assign(sequence_id=sequence, offset=offsets)

    return keyed.groupBy("pack_group").applyInPandas(fit, out)
