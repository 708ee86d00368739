"""Plain versions of the corpus operators, written from their contracts."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _digits(m):
    return re.sub("[^0-9]", "", m)


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(_digits(m[0])) <= 19 and _luhn(_digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m[0])) <= 15),
)
SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def spans(text, kinds):
    """Counts by kind, and the digest."""
    found = sorted((m.start(), k, m.end(), name) for k, (name, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text or "") if ok(m))
    joined = ",".join(f"{name}:{a}:{b}" for a, _, b, name in found)
    return (*(sum(f[3] == name for f in found) for name, _, _ in kinds), hashlib.sha256(joined.encode()).hexdigest())


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest repeat of 8 words or more."""
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = lambda k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    eight = windows(8)
    covered = {j for i in range(len(w) - 7) if eight[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    longest = 0
    if covered:
        #: Whether a repeat of a length exists is monotone; windows are compared as the bytes of their words' numbers.
        number = {x: i for i, x in enumerate(dict.fromkeys(w))}
        flat = np.array([number[x] for x in w], np.uint32).tobytes()
        stands_twice = lambda k: len({flat[4 * i : 4 * (i + k)] for i in range(len(w) - k + 1)}) < len(w) - k + 1
        longest, beyond = 8, len(w)
        while beyond - longest > 1:
            middle = (longest + beyond) // 2
            longest, beyond = (middle, beyond) if stands_twice(middle) else (longest, middle)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), longest


def covered(text, least):
    """Words in repeats of ``least`` words or more."""
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + least]) for i in range(len(w) - least + 1))
    return len({j for i in range(len(w) - least + 1) if windows[tuple(w[i : i + least])] > 1 for j in range(i, i + least)})


def decontaminate(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = TERM.findall((t or "").translate(LOWER))
        if w:
            for j in range(max(1, len(w) - 7)):
                windows[tuple(w[j : j + 8])].add("" if i is None else str(i))
    sizes, out = sorted({len(w) for w in windows}), []
    for d, t in docs:
        w, hit, found = TERM.findall((t or "").translate(LOWER)), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if owners := windows.get(tuple(w[s : s + size])):
                    hit.update(range(s, s + size))
                    found |= owners
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def substrings(docs, length=50):
    last, least = 1 << 62, {}
    rows = [(last if d is None else d, d, (t or "").encode()) for d, t in docs]
    for k, _, b in rows:
        for i in range(len(b) - length + 1):
            least[b[i : i + length]] = min(least.get(b[i : i + length], last), k)
    out = []
    for k, d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < k:
                gone[i : i + length] = b"\1" * length
        n_spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), n_spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def fingerprint(text, size=3):
    own, counts = shingles(text, size), [0] * 64
    for s in own:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(own))


class Union:
    """Groups, each named by its least member."""

    def __init__(self, members):
        self.up = {m: m for m in members}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def simhash_groups(docs, budget=2):
    prints = [fingerprint(t) for _, t in docs]
    nodes = np.array(sorted(set(prints)), np.uint64)
    groups = Union(nodes.tolist())
    for i in range(len(nodes)):
        for j in np.flatnonzero(np.bitwise_count(nodes[i + 1 :] ^ nodes[i]) <= budget):
            groups.link(int(nodes[i]), int(nodes[i + 1 + j]))
    least = {}
    for (d, _), p in zip(docs, prints):
        if d is not None:
            least[groups.find(p)] = min(least.get(groups.find(p), d), d)
    return [(d, format(p, "016x"), least.get(groups.find(p))) for (d, _), p in zip(docs, prints)]


def similar_groups(docs, size=5, similarity=0.8):
    """The document that stands for each other one of its group."""
    sets = {d: set(shingles(t, size)) for d, t in docs}
    holders, groups, seen = defaultdict(list), Union(sets), set()
    for d, s in sets.items():
        for x in s or {None}:
            holders[x].append(d)
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                        groups.link(a, b)
    return {d: groups.find(d) for d in sets if groups.find(d) != d}
