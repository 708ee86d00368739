"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary-trie self-join under a Hamming budget.

Links. Distinct fingerprints are dealt out under masks: two fingerprints that agree on all bits of a mask meet in one group. With budget b,
b + 1 masks that split the 64 bits find every pair (one block must agree); so do the masks of any k of b + k blocks. In a group the sorted fingerprints are a binary trie whose nodes
are stretches of the array; pairs of nodes are walked together from the root, differing bits add up, and a pair over budget is dropped with
all below it. The frontier is cut in halves where it grows long, so memory is bounded. A pair is reported by the first mask it agrees on only.
A group of over HOT fingerprints is cut into chunks, and each pair of chunks is a task's, so no key is held by one task.

Nulls: a null text has no words and fingerprint 0, linked like any other; a null doc_id takes part and gets its group's least id. Repeated
rows and ties share a fingerprint, so a group of copies of any size is one node. Very long texts are hashed in pieces. Empty tables give empty
results; columns other than doc_id and text are left aside, or kept by :func:`drop_near_duplicates`, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnlake.llm import common as C
from tarnlake.llm.components import components

SEED = 42
LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
FRONTIER, CHUNK, PIECE, HOT = 200_000, 200_000, 200_000, 100_000
#: For near duplicates: words in a shingle of op9's fingerprints, differing bits, and blocks that a mask is of (28 masks of 16 bits).
PRINT_SIZE, PRINT_BUDGET, AGREE = 3, 6, 2
SKETCH_BITS, CLUSTER_BYTES, HOT_BYTES, HOT_TEXTS = 18, 4_000_000, 16_000_000, 5_000
_BITS = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def shingles_of(text: bytes, size: int) -> list[bytes]:
    """Shingles of a text's words, A to Z in lower case; the whole sequence where it has fewer words; none without words."""
    words = text.translate(LOWERED).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprint(text: bytes, size: int) -> int:
    """The bits that are set in over half of the shingles' XXH64 values."""
    found = shingles_of(text, size)
    if not found:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        counts += np.unpackbits(hashes[at : at + PIECE].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * counts > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and fp (the fingerprint as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t or b"", size) for t in b.column(1).cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def block_masks(budget: int, agree: int = 1) -> list[int]:
    """Masks of any ``agree`` of budget + agree blocks that split the 64 bits."""
    cuts = [64 * i // (budget + agree) for i in range(budget + agree + 1)]
    return [sum(blocks) for blocks in combinations([((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])], agree)]


def _walk(prints: np.ndarray, group: np.ndarray, budget: int, known: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of :func:`trie_pairs`, a frontier at a time; pairs of nodes are left out where ``known`` holds for their stretches."""
    n = len(prints)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)
    many = ends - starts > 1
    ones: dict[int, np.ndarray] = {}
    stack = [(0, starts[many], ends[many], starts[many], ends[many], np.zeros(int(many.sum()), np.int64))]
    while stack:
        depth, al, ah, bl, bh, dist = stack.pop()
        single = (ah - al == 1) & (bh - bl == 1) & (al != bl)
        if single.any():
            i, j = al[single], bl[single]
            near = np.bitwise_count(prints[i] ^ prints[j]) <= budget
            yield i[near], j[near]
        go = ~single & ~((al == bl) & (ah - al == 1))
        if known:
            go &= ~known(al, ah, bl, bh)
        al, ah, bl, bh, dist = al[go], ah[go], bl[go], bh[go], dist[go]
        if not len(al) or depth == 64:
            continue
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(depth, *(x[s] for x in (al, ah, bl, bh, dist))) for s in (slice(half, None), slice(half))]
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((prints >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        c = ones[depth]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = al == bl
        parts = [(al, am, bl, bm, dist), (am, ah, bm, bh, dist), (al, am, bm, bh, dist + 1), (am[~same], ah[~same], bl[~same], bm[~same], dist[~same] + 1)]
        al, ah, bl, bh, dist = (np.concatenate(x) for x in zip(*parts))
        keep = (ah > al) & (bh > bl) & (dist <= budget)
        stack.append((depth + 1, al[keep], ah[keep], bl[keep], bh[keep], dist[keep]))


def trie_pairs(prints: np.ndarray, group: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of distinct fingerprints of one group that differ in at most ``budget`` bits; both arrays sorted by group, then print."""
    found = list(_walk(prints, group, budget))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def trie_joins(prints: np.ndarray, group: np.ndarray, budget: int) -> np.ndarray:
    """For each place the least one that is reached over the pairs of :func:`trie_pairs`; what is joined already isn't walked again."""
    label = np.arange(len(prints))
    run = label

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal run
        while (apart := label[i] != label[j]).any():
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
            while (label[label] != label).any():
                label[:] = label[label]
        run = np.cumsum(np.append(0, label[1:] != label[:-1]))

    def known(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> np.ndarray:
        return (label[al] == label[bl]) & (run[al] == run[ah - 1]) & (run[bl] == run[bh - 1])

    beside = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(prints[1:] ^ prints[:-1]) <= budget))
    join(beside, beside + 1)
    for i, j in _walk(prints, group, budget, known):
        join(i, j)
    return label


def links(prints: DataFrame, budget: int, hot: int | None = None, agree: int = 1, joined: bool = False) -> DataFrame:
    """(u, v) of distinct fingerprints (column fp) within the budget that agree on a mask; if ``joined``, as many as join what these pairs join,
    no more than there are rows in the groups, so a crowd of close fingerprints doesn't give all its pairs."""
    masks, hot = block_masks(budget, agree), hot or HOT
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; whole groups are solved together, about CHUNK rows at a time."""
        for rows in _whole(batches, CHUNK, lambda b: b.num_rows):
            group, mask, fp, chunk, alone = (rows.column(c).to_numpy() for c in ("grp", "mask", "fp", "chunk", "alone"))
            fp = fp.view(np.uint64)
            order = np.lexsort((fp, mask, group))
            group, mask, fp, chunk, alone = group[order], mask[order], fp[order], chunk[order], alone[order]
            places = np.cumsum(np.append(True, (group[1:] != group[:-1]) | (mask[1:] != mask[:-1])))
            if joined:
                label = trie_joins(fp, places, budget)
                i = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[label[i]].view(np.int64))], ["u", "v"])
                continue
            i, j = trie_pairs(fp, places, budget)
            x = fp[i] ^ fp[j]
            #: Pairs inside a chunk are the task's that holds the chunk alone.
            first = (chunk[i] != chunk[j]) | alone[i].astype(bool)
            for k, m in enumerate(masks):
                first &= (mask[i] <= k) | ((x & np.uint64(m)) != 0)
            yield pa.RecordBatch.from_arrays([pa.array(fp[i[first]].view(np.int64)), pa.array(fp[j[first]].view(np.int64))], ["u", "v"])

    dealt = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)))).alias("d"))
    dealt = dealt.select("d.mask", "d.key", "fp")
    crowded = C.written(dealt.groupBy("mask", "key").count().filter(F.col("count") > hot).select("mask", "key", F.ceil(F.col("count") / hot).cast("int").alias("chunks")), "crowded")
    if crowded.limit(1).count():
        dealt = dealt.join(crowded, ["mask", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    else:
        dealt = dealt.withColumn("chunks", F.lit(1))
    own = dealt.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = F.xxhash64("mask", "key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    rows = own.select(key.alias("grp"), "mask", "fp", "chunk", (F.col("chunk") == F.col("other")).cast("int").alias("alone"))
    #: A chunk with itself is a group of its own, in which all rows are alone.
    rows = rows.repartition("grp").sortWithinPartitions("grp")
    return rows.mapInArrow(solve, "u long, v long")


def hex_of(column: str):
    """16 lowercase hex digits of a long."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def group(docs: DataFrame, size: int = 3, budget: int = 2, **dealt) -> DataFrame:
    """doc_id, fingerprint, component_id: the least doc_id among all that are reached over links; ``dealt`` are options of :func:`links`."""
    prints = C.written(fingerprints(docs, size), "fingerprints")
    nodes = C.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    stars = components(links(nodes.select("fp"), budget, **dealt))
    rooted = nodes.join(stars, nodes["fp"] == stars["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """A 64-bit hash for each place of a shingle in the text, equal where the shingles are; one for a text of fewer words or none."""
    words = text.translate(LOWERED).split()
    w = np.zeros(max(len(words), size), np.uint64)
    w[: len(words)] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(w) - size + 1
    h = np.full(n, SEED, np.uint64)
    for k in range(size):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """How often shingles occur, by the first SKETCH_BITS bits of their hash; the tasks' counts are added up in 64 parts."""
    parts = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for t in b.column(0).cast(pa.large_binary()).to_pylist():
                np.add.at(total, (shingle_hashes(t, size) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int64()), pa.array([x.tobytes() for x in np.split(total, parts)], pa.binary())], ["part", "counts"])

    def add(found: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in found.column("counts").to_pylist())
        return pa.table({"part": found.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "part long, counts binary"
    rows = texts.mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind).collect()
    out = np.zeros((parts, (1 << SKETCH_BITS) // parts), np.int64)
    for r in rows:
        out[r.part] = np.frombuffer(r.counts, np.int64)
    return out.reshape(-1)


def _postings(frequency: np.ndarray, size: int, similarity: float):
    """token, node, n, pos: a text's rarest shingles, as many that two texts similar enough share one; n counts its distinct shingles. Copies in
    one partition are sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                fresh = [not (x in seen or seen.add(x)) for x in part.column(0).to_pylist()]
                part = part.filter(pa.array(fresh))
                if not part.num_rows:
                    continue
                tokens, counts, firsts = [np.zeros(0, np.uint64)], [], []
                for t in part.column(1).cast(pa.large_binary()).to_pylist():
                    h = np.unique(shingle_hashes(t, size))
                    first = len(h) - math.ceil((similarity - 1e-9) * len(h)) + 1
                    tokens.append(h[np.lexsort((h, frequency[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:first]])
                    counts.append(len(h))
                    firsts.append(len(tokens[-1]))
                taken = np.array(firsts, np.int64)
                place = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
                columns = [np.concatenate(tokens).view(np.int64), np.repeat(part.column(0).to_numpy(), taken), np.repeat(np.array(counts, np.int32), taken), place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "node", "n", "pos"])

    return run


def _whole(batches: Iterator[pa.RecordBatch], most: int, weight) -> Iterator[pa.Table]:
    """Batches sorted by their first column, joined and cut anew where that column changes, at about so much weight each."""
    held: list[pa.RecordBatch] = []
    size, limit = 0, most
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += weight(b)
        if size > limit:
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows.column(0).to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
            size = sum(map(weight, held))
            #: A group that goes on is joined again when there is twice as much of it only.
            limit = max(most, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _clusters(similarity: float):
    """leader, node: texts that share a token and can be similar by their numbers of shingles and its places; the leader is the least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, CHUNK, lambda b: b.num_rows):
            token, node, n, pos = (rows.column(i).to_numpy() for i in range(4))
            order = np.lexsort((node, n, token))
            token, node, n, pos = token[order], node[order], n[order].astype(np.int64), pos[order].astype(np.int64)
            fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
            token, node, n, pos = token[fresh], node[fresh], n[fresh], pos[fresh]
            starts = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (n[:-1] < (similarity - 1e-9) * n[1:])))
            sizes = np.diff(np.append(starts, len(token)))
            other = np.where(np.repeat(sizes, sizes) == 2, np.repeat(np.add.reduceat(n, starts), sizes) - n, np.repeat(n[starts], sizes))
            able = n - pos >= (similarity - 1e-9) / (1 + similarity) * (n + other)
            segment = np.repeat(np.arange(len(starts)), sizes)[able]
            node = node[able]
            leader = np.full(len(starts), np.iinfo(np.int64).max)
            np.minimum.at(leader, segment, node)
            many = np.bincount(segment, minlength=len(starts))[segment] > 1
            found = np.unique(np.stack([leader[segment][many], node[many]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["leader", "node"])

    return run


def similar_links(texts: list[bytes], size: int, similarity: float) -> list[tuple[int, int]]:
    """Places of texts, as many links as join all that are reached over pairs similar enough; shingles are compared word by word.

    The first text is compared with all; then each that isn't similar to it with all. Pairs left out are joined already by the first.
    """
    vocabulary: dict[bytes, int] = {}
    words = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in t.translate(LOWERED).split()] for t in texts]
    flat = np.concatenate([np.array(w + [0] * (size - len(w)), np.int64) for w in words])
    lengths = np.array([max(len(w), size) for w in words])
    counts = lengths - size + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = np.arange(counts.sum()) + owner * (size - 1)
    code = flat[starts]
    for k in range(1, size):
        code = np.unique(code * (len(vocabulary) + 1) + flat[starts + k], return_inverse=True)[1]
    kinds = int(code.max()) + 1
    both = np.unique(owner * kinds + code)
    owner, code = both // kinds, both % kinds
    n = np.bincount(owner, minlength=len(texts))
    own = np.append(0, np.cumsum(n))
    holders = owner[np.argsort(code, kind="stable")]
    held = np.bincount(code, minlength=kinds)
    first = np.cumsum(held) - held

    def similar(x: int) -> np.ndarray:
        common = np.zeros(len(texts), np.int64)
        mine, step = code[own[x] : own[x + 1]], max(1, PIECE // len(texts))
        for at in range(0, len(mine), step):
            c = mine[at : at + step]
            lens = held[c]
            common += np.bincount(holders[np.arange(lens.sum()) + np.repeat(first[c] - (np.cumsum(lens) - lens), lens)], minlength=len(texts))
        return common >= similarity * (n[x] + n - common)

    near = similar(0)
    links = [(0, int(y)) for y in np.flatnonzero(near) if y]
    label = np.where(near, 0, np.arange(len(texts)))
    for x in np.flatnonzero(~near):
        for y in np.flatnonzero(similar(x)):
            if label[y] != label[x]:
                links.append((int(x), int(y)))
                label[label == label[y]] = label[x]
    return links


def _verified(size: int, similarity: float):
    """u, v: links of whole clusters; rows are part, node, first, text, sorted by part; a part's first text is compared with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, CLUSTER_BYTES, lambda b: b.nbytes):
            part, node, first, text = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy(), rows.column(3)
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            u, v = [], []
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                order = begin + np.lexsort((node[begin:end], -first[begin:end]))
                order = order[np.append(True, node[order][1:] != node[order][:-1])]
                for i, j in similar_links(text.take(pa.array(order)).cast(pa.large_binary()).to_pylist(), size, similarity):
                    u.append(node[order[i]])
                    v.append(node[order[j]])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _cluster_links(clusters: DataFrame, needed: DataFrame, size: int, similarity: float, hot_bytes: int) -> DataFrame:
    """u, v: links that join all similar texts of each cluster (leader, node); ``needed`` has node, text and n_bytes.

    A cluster of at most ``hot_bytes`` and HOT_TEXTS is one part, compared by one task. A larger one is cut into chunks of about that size, each a
    part with the leader's text, which links what is similar to the leader or meets in its chunk. Texts that this leaves apart from the leader are then
    compared with all chunks, in parts of a chunk of theirs and a chunk of the cluster. So every pair is compared but those that are joined
    already, and in a cluster of copies of one text the work is in proportion to its size.
    """

    def checked(parts: DataFrame) -> DataFrame:
        rows = parts.join(needed.select("node", "text").hint("merge"), "node").select("part", "node", "first", "text")
        return rows.repartition("part").sortWithinPartitions("part").mapInArrow(_verified(size, similarity), "u long, v long")

    weighed = clusters.join(needed.select("node", "n_bytes").hint("merge"), "node")
    chunks = F.greatest(F.ceil(F.sum("n_bytes") / hot_bytes), F.ceil(F.count(F.lit(1)) / HOT_TEXTS)).cast("int")
    heavy = C.written(weighed.groupBy("leader").agg(chunks.alias("chunks")).filter("chunks > 1"), "heavy")
    led = (F.col("node") == F.col("leader")).cast("int").alias("first")
    if not heavy.limit(1).count():
        return checked(clusters.select(F.xxhash64("leader").alias("part"), "node", led))
    light = checked(clusters.join(heavy, "leader", "left_anti").select(F.xxhash64("leader").alias("part"), "node", led))
    crowd = clusters.join(heavy, "leader").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    crowd = C.written(crowd, "crowd")
    members = crowd.filter("node <> leader").select("leader", "chunk", "node")
    leaders = heavy.select("leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("leader").alias("node"))
    apart = members.unionByName(leaders).select(F.xxhash64("leader", "chunk").alias("part"), "node", led)
    found = C.written(checked(apart), "chunk-links")
    stars = components(found)
    #: Texts that the links so far don't join to their leader.
    named = crowd.select("leader", "node", "chunks", "chunk").join(stars.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = heavy.select("leader").join(stars.select(F.col("u").alias("leader"), F.col("root").alias("top")), "leader", "left").withColumn("top", F.coalesce("top", "leader"))
    rest = C.written(named.join(tops, "leader").filter("root <> top").select("leader", "node"), "rest")
    if not rest.limit(1).count():
        return light.unionByName(found)
    groups = rest.join(needed.select("node", "n_bytes").hint("merge"), "node").groupBy("leader").agg(chunks.alias("rests"))
    left = rest.join(groups, "leader").join(heavy, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), F.col("rests")).cast("int").alias("rest"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = crowd.join(groups, "leader").select("leader", "node", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("rest"), "chunk")
    last = left.unionByName(right, allowMissingColumns=False).distinct().select(F.xxhash64("leader", "chunk", "rest").alias("part"), "node", F.lit(0).alias("first"))
    return light.unionByName(found).unionByName(checked(last))


def print_clusters(texts: DataFrame) -> DataFrame:
    """leader, node: texts (node, text) of one component of the trie self-join of their fingerprints, if it has others; the leader is its least node."""
    found = group(texts.select(F.col("node").alias("doc_id"), "text"), PRINT_SIZE, PRINT_BUDGET, agree=AGREE, joined=True)
    found = C.written(found.select(F.col("component_id").alias("leader"), F.col("doc_id").alias("node")).distinct(), "components")
    return found.join(found.filter("leader <> node").select("leader").distinct(), "leader", "left_semi")


def rare_clusters(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """leader, node: texts (node, text) that share one of their rarest shingles and can be similar, around the least node."""
    posted = texts.mapInArrow(_postings(_frequencies(texts.select("text"), size), size, similarity), "token long, node long, n int, pos int")
    return posted.repartition("token").sortWithinPartitions("token").mapInArrow(_clusters(similarity), "leader long, node long").distinct()


def _apart(clusters: DataFrame, stars: DataFrame) -> DataFrame:
    """The clusters whose texts aren't all joined yet."""
    rooted = clusters.join(stars.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return clusters.join(rooted.groupBy("leader").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high"), "leader", "left_semi")


NO_ID = (1 << 63) - 1


def standing(docs: DataFrame, size: int = 5, similarity: float = 0.8, hot_bytes: int | None = None) -> DataFrame:
    """id, node, n, keep_id, keep_node: each id and text (node) of the documents, how many rows have both, and those that stand for its group.

    Groups are exact copies, and texts whose Jaccard similarity of distinct word shingles of ``size`` words is at least ``similarity``, joined
    over all such pairs; the least id stands, of several texts with that id the least node. A null id counts as NO_ID, after all others.

    Only exact copies are one node, named by 64 bits of their MD5. Nodes meet by SimHash: :func:`group` joins fingerprints within PRINT_BUDGET
    bits by its trie self-join, and the texts of a component are compared word by word. No budget of bits holds all similar texts, so an exact way
    finds the rest: two texts similar enough share a shingle among the rarest of each (prefix filter; any order of shingles is right, rarest first
    keeps groups small), so all links lie within clusters of texts around a leader; those that SimHash hasn't joined as a whole are compared
    too. What grows with the corpus is joined by a shuffle at every size.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), C.text_of(docs).alias("text"))
    texts = texts.withColumn("node", node_of(F.col("text")))
    keys = C.written(texts.groupBy("id", "node").agg(F.count(F.lit(1)).alias("n")), "text-keys")
    near = C.written(print_clusters(texts.select("node", "text")), "print-clusters")
    rare = C.written(rare_clusters(texts.select("node", "text"), size, similarity), "clusters")
    #: One row of each node's copies by its id, so that copies aren't brought together.
    least = C.written(keys.groupBy("node").agg(F.min("id").alias("id")), "least")
    wanted = least.join(near.select("node").unionByName(rare.select("node")).distinct(), "node", "left_semi")
    needed = texts.join(wanted.hint("merge"), ["id", "node"], "left_semi").dropDuplicates(["node"])
    needed = C.written(needed.select("node", "text", F.octet_length("text").cast("long").alias("n_bytes")), "needed")
    found = C.written(_cluster_links(near, needed, size, similarity, hot_bytes or HOT_BYTES), "print-links")
    rest = C.written(_apart(rare, components(found)), "apart")
    stars = components(found.unionByName(_cluster_links(rest, needed, size, similarity, hot_bytes or HOT_BYTES)))
    rooted = C.written(least.join(stars, F.col("node") == F.col("u"), "left").select("node", "id", F.coalesce("root", "node").alias("root")), "texts")
    kept = rooted.groupBy("root").agg(F.min(F.struct("id", "node")).alias("keep"))
    named = rooted.join(kept, "root").select("node", F.col("keep.id").alias("keep_id"), F.col("keep.node").alias("keep_node"))
    return keys.join(named, "node").select("id", "node", "n", "keep_id", "keep_node")


def node_of(text: Column) -> Column:
    """64 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, hot_bytes: int | None = None) -> DataFrame:
    """(doc_id, keep_id) of documents that another one stands for; those without an id are left out."""
    found = standing(docs, size, similarity, hot_bytes).filter((F.col("id") != NO_ID) & (F.col("id") != F.col("keep_id")))
    return found.select(F.col("id").alias("doc_id"), "keep_id").distinct()


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row, with all its columns, of each group of documents: of repeated rows with its id and text, any one."""
    found = C.written(standing(docs, **options), "standing")
    marked = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), node_of(C.text_of(docs)).alias("node"))
    gone = found.filter("id <> keep_id or node <> keep_node").select("id", "node")
    left = marked.join(gone.hint("merge"), ["id", "node"], "left_anti")
    again = found.filter("n > 1 and id = keep_id and node = keep_node").select("id", "node")
    if again.limit(1).count():
        left = left.join(again, ["id", "node"], "left_anti").unionByName(left.join(again, ["id", "node"], "left_semi").dropDuplicates(["id", "node"]))
    return left.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return group(C.table(spark, sf_dir, "documents"))
