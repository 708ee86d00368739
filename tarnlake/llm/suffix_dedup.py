"""Exact removal of repeated substrings of LENGTH bytes, by content-defined dealing and prefix-free parsing.

Dealing. No single suffix array can hold a corpus, so equal windows of LENGTH bytes are first brought together: a hash of GRAM bytes is taken
at every byte; the least hash among the grams of a window triggers, and the windows in a row with one trigger form a passage (their bytes,
placed about the trigger). Which trigger a window gets depends on its own bytes alone, so equal windows of any two documents always stand in
passages of the same trigger, at the same place. No passage is longer than REACH + LENGTH. Triggers that one document only has can't hold a
repeat and drop out. The others' passages are dealt into parts by trigger.

Prefix-free parsing orders the windows of a part. Hash triggers (one in PERIOD of the WORD-byte strings) cut its passages into phrases that
begin and end with a trigger, so no phrase's suffix longer than a trigger is the beginning of another's. Distinct phrases are the dictionary,
the passages as sequences of them the parse. The suffixes of the dictionary that begin a window are sorted, and the suffixes of the parse are
sorted by prefix doubling; the rank of a window's phrase suffix, then that of the parse from the next phrase on, give the part's order. The
more repetitive its text is, the fewer bytes are compared. Neighbours with LENGTH bytes in common are an interval of equal windows; its least
doc_id goes back to the passages and so to the texts.

Steps (each a shuffle of packed arrays, not of rows for bytes): texts are dealt into groups of about GROUP_BYTES; groups send distinct triggers
to parts; parts answer with shared ones; groups send distinct passages of these with their least doc_id; parts answer with the least doc_id of
every window; groups remove bytes. Within a group, copies of a passage are sent once, so a text that a third of all documents hold costs a
part one passage a group. Groups grow with the corpus up to MOST_GROUP_BYTES so that there are not much more than GROUPS of them, and such a
passage, of under 100 bytes a group, stays small: about 2 MB for 30 GB of text and 160 MB for 100 TB. All comparisons of windows are of bytes; hashes only deal out work.

Nulls: a null text is empty; a null doc_id counts as larger than any other. Documents that share an id, and repeated rows, don't remove each
other's bytes. Long texts are parsed in pieces; a group's memory is a few times its text, or about 90 bytes for each byte of a text of one
repeated letter. Empty tables give empty results; columns other than doc_id and text are left aside, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnlake.llm import common as C

LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM
WIDE = REACH + LENGTH
GROUP_BYTES, PARSE_BYTES, PART_ROWS, SLICE_ROWS, GROUPS_A_PART = 1_500_000, 100_000, 8_000, 40_000, 4
#: Prefix-free parsing: bytes of a trigger, and how many strings have one.
WORD, PERIOD = 8, 16
#: How many groups there are before they grow, and what they grow to: a group takes about nine times its text of memory. How many tasks there
#: are at most where the session doesn't ask for more.
GROUPS, MOST_GROUP_BYTES, MOST_TASKS = 20_000, 64_000_000, 20_000
LAST = np.iinfo(np.int64).max
_PLACE = np.uint64((1 << 30) - 1)
NONE = (*([np.zeros(0, np.int64)] * 4), np.zeros(0, np.uint64))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mixed(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """A 64-bit hash of three words."""
    h = first * _ODD[0]
    spare = np.empty_like(h)
    for word, odd in ((second, _ODD[1]), (third, _ODD[2])):
        np.right_shift(h, np.uint64(29), out=spare)
        h ^= spare
        h += word
        h *= odd
    np.right_shift(h, np.uint64(32), out=spare)
    h ^= spare
    h *= _ODD[0]
    np.right_shift(h, np.uint64(29), out=spare)
    h ^= spare
    return h


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each byte on."""
    w = data.astype(np.uint64)
    for size in (1, 2, 4):
        w = w[:-size] | (w[size:] << np.uint64(8 * size))
    n = len(data) - GRAM + 1
    return _mixed(w[:n], w[8 : 8 + n], w[16 : 16 + n])


def _spread(h: np.ndarray) -> np.ndarray:
    """Least hashes are small numbers; mixed once more they spread evenly over parts."""
    h = h * _ODD[1]
    h ^= h >> np.uint64(32)
    h *= _ODD[2]
    return h ^ (h >> np.uint64(29))


def triggers_of(rows: np.ndarray) -> np.ndarray:
    """The triggers' hashes of phrases."""
    words = np.ascontiguousarray(rows[:, REACH : REACH + GRAM]).view("<u8")
    return _spread(_mixed(*(np.ascontiguousarray(words[:, i]) for i in range(3))))


def _phrases(data: np.ndarray, ends: np.ndarray, base: int, first_doc: int) -> tuple[np.ndarray, ...]:
    """Phrases of some texts in a row: first and last window start and trigger (counted from ``-base``), text, trigger's hash."""
    if len(data) < LENGTH:
        return NONE
    h = grams(data)
    low = h & ~_PLACE
    low |= np.arange(len(h), dtype=np.uint64)
    for size in (1, 2, 4, 8):
        low = np.minimum(low[:-size], low[size:])
    rest = REACH + 1 - 16
    low = np.minimum(low[: len(low) - rest], low[rest:])
    #: A phrase begins where the trigger changes, where a text begins, and (to be dropped) where windows would leave a text.
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    edges = np.concatenate([ends[:-1], ends - LENGTH + 1])
    new[edges[(edges >= 0) & (edges < len(low))]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    doc = np.searchsorted(ends, first, "right")
    good = first + LENGTH <= ends[doc]
    first, last, doc = first[good], last[good], doc[good]
    where = (low[first] & _PLACE).astype(np.int64)
    return first + base, last + base, where + base, doc + first_doc, _spread(h[where])


class Parsed:
    """The phrases of a group's texts: first and last window start, trigger's place and hash, and the text each belongs to."""

    def __init__(self, docs: pa.Table):
        ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
        rows = sorted(zip((LAST if i is None else i for i in ids), (t or b"" for t in texts), ids), key=lambda r: (r[0], r[1]))
        self.keys, self.texts, self.ids = (list(x) for x in zip(*rows)) if rows else ([], [], [])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.key = np.array(self.keys, np.int64)
        #: Texts are parsed some at a time, long ones in pieces that overlap: the arrays of eight bytes for each byte stay small.
        found, begin = [], 0
        while begin < len(self.texts):
            base = int(self.ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(self.ends, base + PARSE_BYTES, "right")))
            last = int(self.ends[end - 1])
            if last - base > PARSE_BYTES:
                for at in range(base, last - LENGTH + 1, PARSE_BYTES):
                    stop = min(last, at + PARSE_BYTES + LENGTH - 1)
                    found.append(_phrases(self.data[at:stop], np.array([stop - at]), at, begin))
            else:
                found.append(_phrases(self.data[base:last], self.ends[begin:end] - base, base, begin))
            begin = end
        found.append(NONE)
        self.first, self.last, self.trigger, self.doc, self.hash = (np.concatenate(c) for c in zip(*found))

    def triggers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigger hashes, and whether documents of different ids have them here."""
        order = np.lexsort((self.key[self.doc], self.hash))
        h, k = self.hash[order], self.key[self.doc][order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(h)) - 1
        return h[begin], (k[begin] != k[end]) if len(h) else new

    def dictionary(self, shared: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases with shared triggers: which they are and the number of the distinct phrase of each; and of the distinct ones, by
        trigger: hash, bytes (with first and last window in two more), least doc key."""
        names = _names(self.hash, parts)
        at = np.searchsorted(shared, names)
        at[at == len(shared)] = 0
        own = np.flatnonzero(shared[at] == names) if len(shared) else np.zeros(0, np.int64)
        columns = np.arange(WIDE, dtype=np.int8)
        around = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(REACH, np.uint8), self.data, np.zeros(LENGTH, np.uint8)]), WIDE)
        numbers, held, before = [], [NONE_DISTINCT], 0
        #: Distinct ones of many slices, then of all of these.
        for a in range(0, len(own), SLICE_ROWS):
            o = own[a : a + SLICE_ROWS]
            first, last, trigger = self.first[o], self.last[o], self.trigger[o]
            lo, hi = REACH - (trigger - first), REACH - (trigger - last)
            rows = np.zeros((len(o), WIDE + 4), np.uint8)
            low, high = lo.astype(np.int8)[:, None], (hi + LENGTH).astype(np.int8)[:, None]
            rows[:, :WIDE] = around[trigger] * ((columns >= low) & (columns < high))
            rows[:, WIDE], rows[:, WIDE + 1] = lo, hi
            number, chosen, least = distinct(self.hash[o], rows, self.key[self.doc[o]])
            numbers.append(number + before)
            held.append((self.hash[o][chosen], rows[chosen], least))
            before += len(chosen)
        hashes, rows, keys = (np.concatenate(c) for c in zip(*held))
        number, chosen, low = distinct(hashes, rows, keys)
        return own, number[np.concatenate([np.zeros(0, np.int64), *numbers])], hashes[chosen], rows[chosen], low


NONE_DISTINCT = (np.zeros(0, np.uint64), np.zeros((0, WIDE + 4), np.uint8), np.zeros(0, np.int64))


def distinct(hashes: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases by trigger and bytes: the number of the distinct phrase of each, and one of each distinct phrase with the least key of all."""
    mixed = hashes.copy()
    for word in rows.view("<u8").T:
        mixed ^= word
        mixed *= _ODD[1]
        mixed ^= mixed >> np.uint64(31)
    order = np.lexsort((keys, mixed, hashes))
    r, h = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = h[1:] != h[:-1]
    for word in r.view("<u8").T:
        new[1:] |= word[1:] != word[:-1]
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new], keys[order][new]


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _names(hashes: np.ndarray, parts: int) -> np.ndarray:
    """A trigger's short name: its part and 32 bits of its hash. Names that clash only make more phrases candidates."""
    return (_parts(hashes, parts).astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _short(hashes: np.ndarray) -> bytes:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()


def _known(table: pa.Table) -> np.ndarray:
    """Names in rows of part and short hashes."""
    parts, short = table.column("part").to_pylist(), table.column("hashes").to_pylist()
    return np.unique(np.concatenate([(np.uint64(p) << np.uint64(32)) | np.frombuffer(x, np.uint32).astype(np.uint64) for p, x in zip(parts, short)]))


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unsqueezed(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _cuts(part: np.ndarray) -> list[tuple[int, int, int]]:
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    return [(int(part[a]), int(a), int(b)) for a, b in zip(begin, [*begin[1:], len(part)])]


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return np.diff(np.append(begin, len(values))).astype(np.int32), values[begin]


def _ranked(columns: list[np.ndarray]) -> np.ndarray:
    """The dense rank of each row of keys, the first column being the most significant."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _masked(word: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The first n_bytes (0 to 8) bytes of big-endian words."""
    left = np.clip(n_bytes, 0, 8).astype(np.uint64)
    return np.where(left == 0, np.uint64(0), word & ~((np.uint64(1) << (np.uint64(64) - np.maximum(left, np.uint64(1)) * np.uint64(8))) - np.uint64(1)))


class Parse:
    """The prefix-free parse of passages: phrases in turn (row, start, length), their ranks in the dictionary, and the ranks of the parse's
    suffixes. ``words`` has the eight bytes from each byte of a row on; a passage is the bytes from low to high of its row."""

    def __init__(self, words: np.ndarray, low: np.ndarray, high: np.ndarray):
        mixed = words * _ODD[0]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _ODD[1]
        at = np.arange(words.shape[1])
        starts = (mixed >> np.uint64(32)) % np.uint64(PERIOD) == 0
        starts &= (at > low[:, None]) & (at <= high[:, None] - WORD)
        starts[np.arange(len(words)), low] = True
        self.row, self.start = np.nonzero(starts)
        self.last = np.append(self.row[1:] != self.row[:-1], np.ones(min(1, len(self.row)), bool))
        end = high[self.row]
        end[:-1][~self.last[:-1]] = self.start[1:][~self.last[:-1]] + WORD
        self.length = end - self.start
        flat, step = words.ravel(), words.shape[1]
        columns = []
        for k in range(0, WIDE, 8):
            where = np.minimum(self.start + k, step - 1)
            columns.append(_masked(flat[self.row * step + where], np.where(self.start + k < step, self.length - k, 0)))
        #: The last words of a row begin at its last byte but seven, so what stands beyond is told by shifting.
        for i, k in enumerate(range(0, WIDE, 8)):
            late = (self.start + k >= step) & (self.length > k)
            if late.any():
                shift = ((self.start + k - step + 1)[late] * 8).astype(np.uint64)
                columns[i][late] = _masked(flat[self.row[late] * step + step - 1] << shift, (self.length - k)[late])
        self.dictionary = _ranked([*columns, self.length])
        #: Suffixes of the parse, by doubling; what follows a passage's last phrase is less than any phrase.
        rank, size = self.dictionary, 1
        turn = np.arange(len(rank)) - np.concatenate([[0], np.flatnonzero(self.last)[:-1] + 1])[np.cumsum(np.append(0, self.last[:-1]))] if len(rank) else rank
        while len(rank) and size <= turn.max():
            next_ = np.zeros(len(rank), np.int64)
            inside = np.flatnonzero(self.row[size:] == self.row[:-size])
            next_[inside] = rank[inside + size] + 1
            rank = np.unique(rank * (len(rank) + 1) + next_, return_inverse=True)[1]
            size *= 2
        self.suffixes = rank


def least_of_windows(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each passage of a part and each of its windows, in turn: the least key of the equal windows, from the part's order by its parse."""
    lo, counts = rows[:, WIDE].astype(np.int64), rows[:, WIDE + 1].astype(np.int64) - rows[:, WIDE] + 1
    words = np.zeros((len(rows), WIDE - 7), np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | rows[:, i : i + WIDE - 7]
    parse = Parse(words, lo, lo + counts - 1 + LENGTH)
    row = np.repeat(np.arange(len(rows)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts - lo, counts)
    at, flat = row * words.shape[1] + place, words.ravel()
    phrase = np.searchsorted(parse.row * WIDE + parse.start, row * WIDE + place, "right") - 1
    inner = place - parse.start[phrase]
    left = parse.length[phrase] - inner
    #: The dictionary's suffixes that begin windows, each once, sorted as far as a window reaches.
    _, one, number = np.unique(parse.dictionary[phrase] * WIDE + inner, return_index=True, return_inverse=True)
    offsets = (*range(0, LENGTH - 8, 8), LENGTH - 8)
    suffix = _ranked([*(_masked(flat[at[one] + o], left[one] - o) for o in offsets), np.minimum(left[one], LENGTH)])[number]
    follows = np.where(left < LENGTH, parse.suffixes[np.minimum(phrase + 1, len(parse.row) - 1)], 0)
    order = np.argsort(suffix * (len(parse.row) + 1) + follows, kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for o in offsets:
        w = flat[at + o][order]
        new[1:] |= w[1:] != w[:-1]
    begin = np.flatnonzero(new)
    low = np.minimum.reduceat(keys[row][order], begin) if len(begin) else keys[:0]
    least = np.empty(len(order), np.int64)
    least[order] = low[np.cumsum(new) - 1]
    return least


def dedup(docs: DataFrame, group_bytes: int | None = None, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes)."""
    slim = docs.select(F.col("doc_id").cast("long"), C.text_of(docs).cast("binary").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    group_bytes = group_bytes or max(GROUP_BYTES, min(MOST_GROUP_BYTES, total // GROUPS))
    n = max(1, -(-total // group_bytes))
    parts = max(1, n // GROUPS_A_PART)
    dealt = slim.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))

    sends = "part long, grp long, hashes binary, many binary"

    def send_triggers(key, table):
        h, many = Parsed(table).triggers()
        return _table(sends, [(p, key[0].as_py(), _short(h[a:b]), np.packbits(many[a:b]).tobytes()) for p, a, b in _cuts(_parts(h, parts))])

    shares = "grp long, part long, hashes binary"

    def share_triggers(key, table):
        groups = table.column("grp").to_pylist()
        hashes = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
        every = np.concatenate(hashes)
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(table.column("many").to_pylist(), hashes)])
        s = np.sort(every)
        known = np.unique(np.concatenate([s[1:][s[1:] == s[:-1]], every[many]]))
        found = []
        for g, h in zip(groups, hashes):
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            own = h[known[at] == h] if len(known) else h[:0]
            if len(own):
                found.append((g, key[0].as_py(), _packed(own)))
        return _table(shares, found)

    phrases = "part long, grp long, phrases binary, keys binary"

    def send_phrases(key, table, shared):
        if not shared.num_rows:
            return _table(phrases, [])
        _, _, h, rows, keys = Parsed(table).dictionary(_known(shared), parts)
        return _table(phrases, [(p, key[0].as_py(), _squeezed(rows[a:b]), _squeezed(keys[a:b])) for p, a, b in _cuts(_parts(h, parts))])

    answers = "grp long, part long, hashes binary, lengths binary, least binary"

    def answer(key, table):
        groups = table.column("grp").to_pylist()
        own_rows = [_unsqueezed(x, np.uint8).reshape(-1, WIDE + 4) for x in table.column("phrases").to_pylist()]
        rows = np.concatenate(own_rows)
        keys = np.concatenate([_unsqueezed(x, np.int64) for x in table.column("keys").to_pylist()])
        every = triggers_of(rows)
        counts = rows[:, WIDE + 1].astype(np.int64) - rows[:, WIDE] + 1
        ends = np.cumsum(counts)
        number, chosen, low = distinct(every, rows, keys)
        #: A trigger with one phrase only has equal windows throughout; the others' phrases are ranked, whole triggers, about PART_ROWS at a time.
        h = every[chosen]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        edges = np.append(np.flatnonzero(new), len(h))
        sizes = np.diff(edges)
        several = np.flatnonzero(np.repeat(sizes > 1, sizes))
        own_counts = counts[chosen]
        begins = np.cumsum(own_counts) - own_counts
        values = np.repeat(low, own_counts)
        bounds = np.append(np.cumsum(np.concatenate([[0], sizes[sizes > 1]]))[:-1], len(several))
        a = 0
        while a < len(several):
            b = int(bounds[max(np.searchsorted(bounds, a, "right"), np.searchsorted(bounds, a + PART_ROWS, "right") - 1)])
            own = several[a:b]
            c = own_counts[own]
            to = np.repeat(begins[own] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            values[to] = least_of_windows(rows[chosen[own]], low[own])
            a = b
        least = values[np.repeat(begins[number] - (ends - counts), counts) + np.arange(int(counts.sum()))]
        found, at = [], 0
        windows = np.concatenate([[0], ends])
        for g, own in zip(groups, own_rows):
            end = at + len(own)
            lengths, low = _runs(least[windows[at] : windows[end]])
            found.append((g, key[0].as_py(), _short(np.unique(every[at:end])), _squeezed(lengths), _squeezed(low)))
            at = end
        return _table(answers, found)

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept

    def remove(key, table, said):
        parsed = Parsed(table)
        marks = np.zeros(len(parsed.data) + 1, np.int32)
        if said.num_rows:
            turn = np.argsort(said.column("part").to_numpy())
            column = lambda name, kind: np.concatenate([_unsqueezed(said.column(name)[int(i)].as_py(), kind) for i in turn])
            own, number, _, rows, _ = parsed.dictionary(_known(said), parts)
            least = np.repeat(column("least", np.int64), column("lengths", np.int32))
            counts = rows[:, WIDE + 1].astype(np.int64) - rows[:, WIDE] + 1
            begin = np.cumsum(counts) - counts
            for a in range(0, len(own), PART_ROWS):
                o, d = own[a : a + PART_ROWS], number[a : a + PART_ROWS]
                c = counts[d]
                inner = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                earlier = least[np.repeat(begin[d], c) + inner] < np.repeat(parsed.key[parsed.doc[o]], c)
                starts = (np.repeat(parsed.first[o], c) + inner)[earlier]
                np.add.at(marks, starts, 1)
                np.add.at(marks, starts + LENGTH, -1)
        gone = np.cumsum(marks[:-1]) > 0
        found, at = [], 0
        for doc_id, end in zip(parsed.ids, parsed.ends):
            mask, data = gone[at:end], parsed.data[at:end]
            removed = int(mask.sum())
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0
            kept = data[~mask].tobytes() if removed else data.tobytes()
            found.append((doc_id, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_kept))
            at = end
        return _table(result, found)

    #: A part, or the groups of a part's size, to a task: none has many by chance, so the largest task doesn't grow with the corpus.
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(usual, min(parts, MOST_TASKS))
    spread = lambda df, key: df.repartition(tasks, key).groupBy(key)
    groups = spread(dealt, "grp")
    known = spread(groups.applyInArrow(send_triggers, sends), "part").applyInArrow(share_triggers, shares)
    sent = groups.cogroup(spread(known, "grp")).applyInArrow(send_phrases, phrases)
    said = spread(sent, "part").applyInArrow(answer, answers)
    return groups.cogroup(spread(said, "grp")).applyInArrow(remove, result)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exact substring deduplication removes from every document."""
    return dedup(C.table(spark, sf_dir, "documents"), with_kept=False)
