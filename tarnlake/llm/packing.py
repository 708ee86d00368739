"""Packing of tokenized documents into sequences, by order-preserving dynamic programming with a monotone queue.

A partition's documents stand in a row, each followed by the end token. Cuts fall at the end of a document (free) or of a sentence (at a price,
in tokens); only where no such place comes for over WIDTH tokens may a sentence be cut, at every GRID-th of its tokens, at a higher price. The
cost of a plan is its padding, the prices of its cuts and of its short sequences. A sequence of a power of two isn't padded, any other to WIDTH;
one of a power of two below WIDTH costs SHORT_PRICE, or there would be many. The best plan up to place i is price(i) plus the least of
best[j] + WIDTH - (i - j) over places j in reach and best[j] + SHORT_PRICE over places j a power of two before i. Since i adds the same to all of the first, a queue of rising best[j] + j gives their best in constant time; the second are eleven at most.
Stretches of STRETCH tokens are planned at once; the last window of a stretch is planned anew with the next one, so a partition pads one
sequence only beyond what the plan chose.

Ids are those of the byte-level BPE vocabulary as ``encode(text, add_special_tokens=False)`` gives them: the string of a special token in a text
is that token. Nulls: a null text is empty and gives the end token alone; a null doc_id stays. Repeated rows are packed like any others, ties
between plans go to the longer last sequence. Very long texts are cut like others and held in memory one at a time. An empty table gives no
rows; columns other than doc_id and text are left aside. Nothing is shuffled, and a retried task gives the same rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnlake.llm import common as C

WIDTH, END_ID, GRID, STRETCH = 1024, 0, 64, 400_000
SENTENCE_PRICE, GRID_PRICE, SHORT_PRICE = 3, 12, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Texts with words or blanks of so many characters go to the library whose merges take n log n time on one long piece.
LONG_PIECE = 1000
LONG = re.compile(rf"\S{{{LONG_PIECE}}}|\s{{{LONG_PIECE}}}")


class Vocabulary:
    """Byte-level BPE ids of texts, and which ids end a sentence."""

    def __init__(self, ranks_path: str | None = None, json_path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(self.json_path, encoding="utf-8") as file:
            self.special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.slow = None
        self.ends = np.zeros(1 + max([*ranks.values(), *self.special.values()]), bool)
        for token, i in ranks.items():
            self.ends[i] = token.endswith((b".", b"!", b"?", b"\n"))

    def encode(self, text: str) -> np.ndarray:
        if long_piece(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


def long_piece(text: str) -> bool:
    """Whether a text has a word or blanks of LONG_PIECE characters; most are told by their ASCII blanks alone.

    A run of blanks that mixes in others may be missed, which costs time and changes no id."""
    if len(text) < LONG_PIECE:
        return False
    blanks = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) <= 32)
    edges = np.concatenate([[-1], blanks, [len(text) * 4]])
    if np.diff(edges[:-1]).max(initial=0) <= LONG_PIECE and len(text.encode()) - edges[-2] <= LONG_PIECE:
        return len(blanks) >= LONG_PIECE and bool((blanks[LONG_PIECE - 1 :] - blanks[: 1 - LONG_PIECE] == LONG_PIECE - 1).any()) and bool(LONG.search(text))
    return bool(LONG.search(text))


def powers_before(places: np.ndarray, width: int) -> tuple[list[int], list[int], list[int]]:
    """Pairs of places that lie a power of two below width apart, by the later one: indexes of the later and the earlier place, and the power."""
    later, earlier, powers = [], [], []
    power = 1
    while power < width:
        at = np.searchsorted(places, places - power)
        own = np.flatnonzero((places[at] == places - power) & (places >= power))
        later.append(own)
        earlier.append(at[own])
        powers.append(np.full(len(own), power))
        power *= 2
    columns = [np.concatenate(c) for c in (later, earlier, powers)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order].tolist() for c in columns)


def plan(places: list[int], prices: list[int], width: int) -> list[int]:
    """The best cuts: indexes into places, which rise from 0 by at most width; the last place is a cut."""
    n = len(places)
    keys, back = [0] * n, [0] * n
    queue = deque([0])
    later, earlier, powers = powers_before(np.array(places), width)
    later.append(n)
    at_pair = 0
    for i in range(1, n):
        at = places[i]
        while places[queue[0]] < at - width:
            queue.popleft()
        j = queue[0]
        #: keys are best + place, so a plan's cost from j on is keys[j] + width with padding and keys[j] + (i - j) without.
        key = keys[j] + width
        while later[at_pair] == i:
            k = earlier[at_pair]
            if (short := keys[k] + powers[at_pair] + SHORT_PRICE) < key:
                j, key = k, short
            at_pair += 1
        back[i] = j
        key = keys[i] = key + prices[i]
        while queue and keys[queue[-1]] > key:
            queue.pop()
        queue.append(i)
    cuts, i = [], n - 1
    while i:
        cuts.append(i)
        i = back[i]
    return cuts[::-1]


def cut_places(tokens: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, width: int = WIDTH, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may fall, from 0 to the end, and their prices."""
    n = len(tokens)
    price = np.full(n + 1, -1, np.int64)
    price[1:][sentence_ends[tokens]] = SENTENCE_PRICE
    price[doc_ends] = 0
    price[0] = price[n] = 0
    places = np.flatnonzero(price >= 0)
    for k in np.flatnonzero(np.diff(places) > width):
        price[places[k] + grid : places[k + 1] : grid] = GRID_PRICE
    places = np.flatnonzero(price >= 0)
    return places, price[places]


class Packer:
    """Packs a stream of (doc_id, ids) into rows of SCHEMA."""

    def __init__(self, ends: np.ndarray, first_sequence: int, width: int = WIDTH):
        self.ends, self.width, self.sequence = ends, width, first_sequence
        #: Documents at hand: id, ids not packed yet, how many ids came before these, number of all ids.
        self.docs: list[tuple[int | None, np.ndarray, int, int]] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.held += len(ids)
        return self.pack(False) if self.held >= STRETCH else []

    def pack(self, final: bool) -> list[tuple]:
        if not self.docs:
            return []
        tokens = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        places, prices = cut_places(tokens, ends, self.ends, self.width)
        cuts = places[plan(places.tolist(), prices.tolist(), self.width)]
        if not final:
            cuts = cuts[:-1]
        if not len(cuts):
            return []
        starts = np.concatenate([[0], cuts[:-1]])
        edges = np.unique(np.concatenate([[0], ends[ends < cuts[-1]], cuts]))
        a, b = edges[:-1], edges[1:]
        doc, seq = np.searchsorted(ends, a, "right"), np.searchsorted(cuts, a, "right")
        begins = ends - [len(d[1]) for d in self.docs]
        rows = []
        for x, y, d, s in zip(a.tolist(), b.tolist(), doc.tolist(), seq.tolist()):
            doc_id, _, before, total = self.docs[d]
            rows.append((doc_id, before + x - int(begins[d]), y - x, zlib.crc32(tokens[x:y].astype("<u4").tobytes()), total, self.sequence + s, x - int(starts[s])))
        self.sequence += len(cuts)
        last = int(cuts[-1])
        self.docs = [(i, ids[max(0, last - int(p)) :], before + max(0, last - int(p)), total) for (i, ids, before, total), p, e in zip(self.docs, begins, ends) if e > last]
        self.held = len(tokens) - last
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)


def pack(docs: DataFrame, width: int = WIDTH, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """A row for each piece of a document in a sequence; paths of the vocabulary files, as executors see them, may be given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(ranks_path, json_path)
        packer = Packer(words.ends, TaskContext.get().partitionId() << 36, width)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += packer.add(doc_id, np.append(words.encode(text or ""), np.uint32(END_ID)))
            yield _batch(rows)
        yield _batch(packer.pack(True))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(C.table(spark, sf_dir, "documents"))
