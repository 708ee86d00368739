"""Quality rules on repetition, from suffix arrays of words.

Documents of a batch are encoded as word numbers. The suffix array comes by prefix doubling (1, 2, 4, 8, ... words); suffixes that differ drop
out, so each round sorts the groups that are still equal alone. Ranks of the rounds give the longest common prefixes of neighbours, and these
the longest repeat that begins at each word, the intervals' maximal repeats and their spans. The verdict limits the fraction of the words that
lie in the union of maximal repeats of SHORT words or more, and the longest repeat. One rule doesn't come from the suffix array: texts with
over MOST_SYMBOLS of the symbols for each word are rejected too.

Nulls: a null text has no words; a null doc_id stays. Repeated rows each give a row; ties don't arise, as every count is the document's own.
Very long texts are batches of their own: work is n log n in their words, memory in proportion. Empty tables give empty results; columns other
than doc_id and text are left aside by :func:`measure` and kept by :func:`keep`, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tarnlake.llm import common as C

#: Words of the contract's windows, and of the shortest repeat that counts for the verdict; powers of two.
WINDOW, SHORT = 8, 4
#: Limits of the verdict: fraction of the words in maximal repeats, and longest repeat, in words and as a fraction of the words.
MOST_COVERED, LONGEST_WORDS, LONGEST_FRACTION = 0.40, 50, 0.25
#: The rule beside the method: symbols for each word.
SYMBOLS, MOST_SYMBOLS = "[#*$%&|<>]", 0.10
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_maximal_words long, longest_repeat long"
BATCH_CHARS = 4_000_000


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of stretches of an array."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _split(texts: pa.Array, pattern: str, regex: bool) -> tuple[pa.Array, np.ndarray]:
    """Flat pieces without empty ones, and each text's place among them."""
    parts = (pc.split_pattern_regex if regex else pc.split_pattern)(texts, pattern)
    flat, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(full), kept[ends]


class Suffixes:
    """The suffix array of word codes in documents, by prefix doubling, with the ranks of every power of two.

    A rank is the place of a group of suffixes that are equal as far as they were compared; suffixes of different documents are never equal.
    Each round compares twice as many words and sorts the groups that still have several members only.
    """

    def __init__(self, codes: np.ndarray, doc: np.ndarray):
        n = len(codes)
        self.n, self.doc = n, doc
        ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], np.ones(min(1, n), bool))) + 1
        self.end = ends[np.searchsorted(ends, np.arange(n), "right")] if n else ends
        key = doc.astype(np.int64) * (int(codes.max()) + 1 if n else 1) + codes
        self.order = np.argsort(key, kind="stable")
        self.ranks: list[np.ndarray] = []
        rank = np.empty(n, np.int64)
        rank[self.order], open_ = self._groups(key[self.order], np.arange(n))
        size = 1
        while True:
            self.ranks.append(rank.copy())
            if not len(open_):
                return
            own = self.order[open_]
            next_ = own + size
            inside = next_ < self.end[own]
            key = np.where(inside, rank[np.where(inside, next_, 0)], -1)
            turn = np.lexsort((key, rank[own]))
            own, key = own[turn], key[turn] + 1
            self.order[open_] = own
            groups = rank[own] * (n + 1) + key
            rank[own], open_ = self._groups(groups, open_)
            size *= 2

    @staticmethod
    def _groups(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of sorted keys at these places of the array, and the places of keys that stand more than once."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(keys)))
        return np.repeat(places[first], sizes), places[np.repeat(sizes > 1, sizes)]

    def lcp(self, least: int) -> np.ndarray:
        """For each place of the suffix array but the first: how many words it has in common with the one before, or 0 if under ``least``,
        a power of two. Found by adding powers of two from the highest down."""
        found = np.zeros(max(0, self.n - 1), np.int64)
        level = least.bit_length() - 1
        if level >= len(self.ranks):
            return found
        in_order = self.ranks[level][self.order]
        pairs = np.flatnonzero(in_order[1:] == in_order[:-1])
        a, b = self.order[pairs], self.order[pairs + 1]
        common = np.zeros(len(pairs), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + common, b + common
            inside = (x < self.end[a]) & (y < self.end[b])
            same = inside & (self.ranks[k][np.where(inside, x, 0)] == self.ranks[k][np.where(inside, y, 0)])
            common += same.astype(np.int64) << k
        found[pairs] = common
        return found


def _covered(starts: np.ndarray, lengths: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, the words in the union of spans."""
    marks = np.zeros(len(doc) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + lengths, -1)
    return np.bincount(doc[np.cumsum(marks[:-1]) > 0], minlength=n_docs)


def repeats(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words covered by repeats of WINDOW words or more, words covered by maximal repeats of SHORT words or more, and the length
    of the longest repeat of WINDOW words or more.

    The longest repeat that begins at a word is the larger of its suffix's common prefixes with its neighbours in the suffix array. It is
    maximal where the word before doesn't begin one that is longer by one.
    """
    n = len(codes)
    suffixes = Suffixes(codes, doc)
    common = np.concatenate([[0], suffixes.lcp(SHORT), [0]])
    longest = np.zeros(n, np.int64)
    longest[suffixes.order] = np.maximum(common[:-1], common[1:])[:n]
    extended = np.zeros(n, bool)
    extended[1:] = (longest[:-1] == longest[1:] + 1) & (doc[1:] == doc[:-1])
    maximal = np.flatnonzero((longest >= SHORT) & ~extended)
    long = maximal[longest[maximal] >= WINDOW]
    top = np.zeros(n_docs, np.int64)
    np.maximum.at(top, doc[long], longest[long])
    return _covered(long, longest[long], doc, n_docs), _covered(maximal, longest[maximal], doc, n_docs), top


def measures(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The counts of a batch of documents."""
    n = len(texts)
    words, w_at = _split(texts, "[\\x20\\x09-\\x0D]+", True)
    lines, l_at = _split(texts, "\n", False)
    real = pc.match_substring_regex(lines, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False).astype(bool)
    line_doc = np.repeat(np.arange(n), np.diff(l_at))[real]
    line_code = lines.filter(pa.array(real)).dictionary_encode().indices.to_numpy().astype(np.int64)
    n_lines = np.bincount(line_doc, minlength=n)
    distinct = np.unique(line_doc * (len(line_code) + 1) + line_code) // (len(line_code) + 1)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(w_at))
    covered, maximal, longest = repeats(codes, doc, n)
    columns = [
        ids,
        np.diff(w_at),
        _sums(pc.utf8_length(words).to_numpy(), w_at),
        pc.count_substring_regex(texts, SYMBOLS).to_numpy().astype(np.int64),
        n_lines - np.bincount(distinct, minlength=n),
        covered,
        maximal,
        longest,
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of batches of about BATCH_CHARS, one row at least, with their texts."""
    for b in batches:
        texts = pc.fill_null(b.column(text).cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_CHARS, "right")))
            yield b.slice(at, end - at), pa.concat_arrays([texts.slice(at, end - at)])
            at = end


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in _slices(batches, "text"):
        yield measures(rows.column("doc_id").cast(pa.int64()), texts)


def verdicts(prefix: str = "") -> tuple[Column, Column]:
    """base_failed, and rejected by this operator's own limits, from the counts."""
    c = lambda name: F.col(prefix + name)
    failed = (c("n_words") < 20) | (c("n_repeat_words") * 100 > c("n_words") * 30)
    repetitive = (c("n_maximal_words") > c("n_words") * MOST_COVERED) | ((c("longest_repeat") >= LONGEST_WORDS) & (c("longest_repeat") > c("n_words") * LONGEST_FRACTION))
    return failed, repetitive | (c("n_symbols") > c("n_words") * MOST_SYMBOLS)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and all counts of the quality rules, with base_failed and kept."""
    failed, rejected = verdicts()
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_batches, SCHEMA)
    return found.withColumn("base_failed", failed).withColumn("kept", ~(failed | rejected))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that the rules keep; nothing is joined or shuffled."""
    prefix, names = "_quality_", [f.split()[0] for f in SCHEMA.split(", ")][1:]
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _slices(batches, text):
            counts = measures(pa.nulls(len(texts), pa.int64()), texts)
            yield pa.RecordBatch.from_arrays([*rows.columns, *counts.columns[1:]], [*rows.schema.names, *(prefix + n for n in names)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + n, T.LongType()) for n in names)])
    failed, rejected = verdicts(prefix)
    return docs.mapInArrow(run, schema).filter(~(failed | rejected)).select(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return measure(C.table(spark, sf_dir, "documents"))
