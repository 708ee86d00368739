"""Benchmark decontamination by a positional inverted index. Native DataFrame operations only.

1. Frequencies of the benchmark's words over the whole corpus.
2. Each benchmark window (``size`` words; a shorter item is one window) picks its two rarest words as pivots, each item its two rarest.
3. The index: postings (term, document, position) of all pivots over the whole corpus, with the words around those of rarest ones, written as
   a table. A posting of no term for each document holds its number of words.
4. Phrases: the rarest word's list, shifted by its place in the windows, gives starts, which the words around it confirm; they are intersected
   with the next rarest word's shifted list. A posting meets the places that its word has in any windows (no more than ``size``), not the
   windows, so a word that very many windows share makes no more rows.
5. Proximity: documents in which the two rarest words of an item stand at most GAP words apart, in either order.

Words that are no pivot can't start a candidate, so their postings aren't stored; the corpus is never shuffled, only postings are. The
benchmark is broadcast in blocks of at most BLOCK windows, so a larger benchmark means more passes and never a larger broadcast.

Nulls: a null text has no words and no hits; null ids stay (a null item id counts as the empty string). Repeated rows each give a row;
documents that share an id are told apart by their text's hash. Words of equal frequency go by their place. An item without words has no
window. Very long texts are one row while they are split into words. Empty tables give empty or clean results; columns other than ids and
texts are left aside by :func:`scan` and kept by :func:`clean`, whatever they are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnlake.llm import common as C

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE, GAP, BLOCK, VOCABULARY = 8, 8, 50_000, 200_000


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, letters and what is beyond ASCII, A to Z in lower case."""
    return F.array_remove(F.split(C.ascii_lower(text), SEPARATORS), "")


def windows_of(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (window, item_id) with the window's words joined by blanks."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(C.text_of(items)).alias("words")).filter(F.size("words") > 0)
    starts = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))).alias("i"))
    return starts.select("item_id", F.array_join(F.slice("words", F.col("i") + 1, size), " ").alias("window")).distinct()


def tokens(docs: DataFrame) -> DataFrame:
    """Documents by key (doc_id, hash of the text) with their words."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(C.text_of(docs)).alias("words"))


def _blocks(df: DataFrame, column: str, most: int) -> list[DataFrame]:
    n = -(-max(1, df.count()) // most)
    return [df.filter(F.pmod(F.xxhash64(column), F.lit(n)) == i) for i in range(n)] if n > 1 else [df]


def frequencies(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each word of the vocabulary (column term) stands in the corpus."""
    flat = tokens(docs).select(F.explode("words").alias("term"))
    return reduce(DataFrame.unionByName, (flat.join(F.broadcast(b), "term").groupBy("term").count() for b in _blocks(vocabulary, "term", VOCABULARY)))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of the given terms: term, doc_id, text_hash, n_words, pos, first and around, the words from place ``first`` on.

    ``terms`` has term, before and after: how many words on either side a query may need; nulls for terms that no phrase is confirmed from. The
    term "", if asked for, has one posting a document, after its last word.
    """
    marked = F.concat("words", F.array(F.lit("")))
    flat = tokens(docs).select("doc_id", "text_hash", "words", F.posexplode(marked).alias("pos", "term"))
    kept = flat.join(F.broadcast(terms), "term")
    first = F.greatest(F.col("pos") - F.col("before"), F.lit(0))
    around = F.when(F.col("before").isNotNull(), F.slice("words", first + 1, F.col("pos") - first + F.col("after") + 1))
    return kept.select("term", "doc_id", "text_hash", F.size("words").alias("n_words"), "pos", F.when(F.col("before").isNotNull(), first).alias("first"), around.alias("around"))


def rarest(terms: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """For each group of terms: n_terms and ``all``, structs of count, place and term from the rarest on; both sides are as large as the
    benchmark, so how they are joined is left to Spark."""
    known = terms.join(counts, "term", "left").select(*by, F.struct(F.coalesce("count", F.lit(0)).alias("n"), "place", "term").alias("t"))
    return known.groupBy(*by).agg(F.array_sort(F.collect_list("t")).alias("all"))


def pivots(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """id, window, term, place, n_terms and rank (1: the rarest, 2: the next) of windows (id, window) whose words all stand in the corpus."""
    flat = windows.select("id", "window", F.posexplode(F.split("window", " ")).alias("place", "term"))
    chosen = rarest(flat, counts, ["id", "window"]).filter(F.col("all")[0]["n"] > 0).select("id", "window", F.size("all").alias("n_terms"), F.posexplode(F.slice("all", 1, 2)).alias("rank", "t"))
    return chosen.select("id", "window", F.col("t.term").alias("term"), F.col("t.place").alias("place"), "n_terms", (F.col("rank") + 1).alias("rank"))


def item_pairs(items: DataFrame, counts: DataFrame) -> DataFrame:
    """one, other and item_ids: the two rarest different words of items that have two in the corpus, and these items."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.posexplode(F.array_distinct(words_of(C.text_of(items)))).alias("place", "term"))
    words = words.groupBy("item_id", "term").agg(F.min("place").alias("place"))
    known = words.join(counts.filter("count > 0").select("term"), "term", "left_semi")
    chosen = rarest(known, counts, ["item_id"]).filter(F.size("all") > 1).select("item_id", F.col("all")[0]["term"].alias("one"), F.col("all")[1]["term"].alias("other"))
    return chosen.groupBy("one", "other").agg(F.collect_set("item_id").alias("item_ids"))


def phrase_hits(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text_hash, id (of the window), start, n_terms of the exact occurrences."""
    first, second = chosen.filter("rank = 1"), chosen.filter("rank = 2").select("id", F.col("term").alias("term2"), F.col("place").alias("place2"))
    spots = first.groupBy("term").agg(F.collect_set(F.struct("place", "n_terms")).alias("spots"))
    starts = index.join(F.broadcast(spots), "term").withColumn("spot", F.explode("spots")).select("*", (F.col("pos") - F.col("spot.place")).alias("start"), F.col("spot.place").alias("place"), F.col("spot.n_terms").alias("n_terms"))
    inside = starts.filter((F.col("start") >= 0) & (F.col("start") + F.col("n_terms") <= F.col("n_words")))
    phrase = F.array_join(F.slice("around", F.greatest(F.col("start") - F.col("first") + 1, F.lit(1)), F.col("n_terms")), " ")
    windows = first.join(second, "id", "left").select("id", "window", "place", "n_terms", "term2", "place2")
    one = inside.select("doc_id", "text_hash", "start", "place", "n_terms", phrase.alias("window")).join(F.broadcast(windows), ["window", "place", "n_terms"])
    two = index.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("term").alias("_term"), F.col("pos").alias("_pos"))
    meet = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")) & (F.col("term2") == F.col("_term")) & (F.col("start") + F.col("place2") == F.col("_pos"))
    columns = ["doc_id", "text_hash", "id", "start", "n_terms"]
    one = C.written(one, "starts")
    return one.filter("n_terms = 1").select(*columns).unionByName(one.filter("n_terms > 1").join(two, meet, "left_semi").select(*columns)).distinct()


def near(index: DataFrame, pairs: DataFrame, gap: int) -> DataFrame:
    """doc_id, text_hash, one, other, pos and other_pos where the two indexed terms of a pair stand at most ``gap`` words apart; lists are met
    in stretches of that length, the first word's in three of them each."""
    pairs = pairs.select("one", "other")
    a = index.join(F.broadcast(pairs), F.col("term") == F.col("one")).select("doc_id", "text_hash", "one", "other", "pos", F.explode(F.array(*(F.floor(F.col("pos") / (gap + 1)) + d for d in (-1, 0, 1)))).alias("part"))
    b = index.join(F.broadcast(pairs.select("other").distinct()), F.col("term") == F.col("other")).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("other").alias("_other"), F.col("pos").alias("other_pos"), F.floor(F.col("pos") / (gap + 1)).alias("_part")
    )
    meet = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")) & (F.col("other") == F.col("_other")) & (F.col("part") == F.col("_part"))
    return a.join(b, meet).filter((F.abs(F.col("pos") - F.col("other_pos")) <= gap) & (F.col("pos") != F.col("other_pos"))).select("doc_id", "text_hash", "one", "other", "pos", "other_pos")


def proximity(index: DataFrame, one: str, other: str, gap: int) -> DataFrame:
    """doc_id, text_hash, pos and other_pos where two indexed terms stand at most ``gap`` words apart."""
    pair = index.sparkSession.range(1).select(F.lit(one).alias("one"), F.lit(other).alias("other"))
    return near(index, pair, gap).select("doc_id", "text_hash", "pos", "other_pos")


class Index:
    """The postings of a benchmark's pivots over the corpus, in tables for blocks of the benchmark."""

    def __init__(self, docs: DataFrame, items: DataFrame, size: int = SIZE, with_pairs: bool = False):
        self.owned = C.written(windows_of(items, size), "owned")
        self.windows = C.written(self.owned.select("window").distinct().withColumn("id", F.monotonically_increasing_id()), "windows")
        counts = C.written(frequencies(docs, self.windows.select(F.explode(F.split("window", " ")).alias("term")).distinct()), "frequencies")
        chosen = C.written(pivots(self.windows, counts), "pivots")
        lone = lambda df, term: df.select(F.col(term).alias("term"), F.lit(None).cast("int").alias("before"), F.lit(None).cast("int").alias("after"))
        self.blocks: list[tuple[DataFrame, DataFrame]] = []
        for i, block in enumerate(_blocks(chosen, "id", 2 * BLOCK)):
            first = lambda c: F.when(F.col("rank") == 1, c)
            terms = block.select("term", first(F.col("place")).alias("before"), first(F.col("n_terms") - F.col("place") - 1).alias("after"))
            if not i:
                #: The number of words of every document.
                terms = terms.unionByName(lone(docs.sparkSession.range(1).select(F.lit("").alias("term")), "term"))
            self.blocks.append((block, C.written(postings(docs, terms.groupBy("term").agg(F.max("before").alias("before"), F.max("after").alias("after"))), "postings")))
        self.pairs: list[tuple[DataFrame, DataFrame]] = []
        if with_pairs:
            pairs = C.written(item_pairs(items, counts), "pairs")
            there = chosen.select("term").distinct()
            for block in _blocks(pairs, "one", BLOCK):
                terms = block.select(F.col("one").alias("term")).unionByName(block.select(F.col("other").alias("term"))).distinct()
                extra = terms.join(there, "term", "left_anti") if len(self.blocks) == 1 else terms
                index = self.blocks[0][1] if len(self.blocks) == 1 else None
                if extra.limit(1).count():
                    more = C.written(postings(docs, lone(extra, "term")), "pair-postings")
                    index = more if index is None else index.unionByName(more)
                self.pairs.append((block, index))

    def hits(self) -> DataFrame:
        """All occurrences of benchmark windows in the corpus."""
        return C.written(reduce(DataFrame.unionByName, (phrase_hits(index, block) for block, index in self.blocks)), "hits")

    def owners(self) -> DataFrame:
        """The items (item_id) of the windows (id)."""
        return self.owned.join(self.windows, "window").select("id", "item_id")

    def lengths(self) -> DataFrame:
        """doc_id, text_hash and n_words, a row for each document."""
        return self.blocks[0][1].filter("term = ''").select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"))

    def near_items(self, gap: int = GAP) -> DataFrame:
        """doc_id, text_hash and near_items: items whose two rarest words stand close to each other."""
        found = []
        for block, index in self.pairs:
            if index is not None:
                met = near(index, block, gap).select("doc_id", "text_hash", "one", "other").distinct()
                found.append(met.join(block, ["one", "other"]).select("doc_id", "text_hash", F.explode("item_ids").alias("item_id")))
        every = reduce(DataFrame.unionByName, found)
        return every.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("near_items"))


def scan(docs: DataFrame, items: DataFrame, size: int = SIZE, least_items: int = 2, gap: int = GAP) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, n_near (items by proximity), and the ids, hit_items and near_items."""
    docs = docs.select("doc_id", "text")
    index = Index(docs, items, size, with_pairs=True)
    found = index.hits()
    key = ["doc_id", "text_hash"]
    covered = found.select(*key, "start", "n_terms").distinct().select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_terms") - 1)).alias("pos")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select(*key, "id").distinct().join(index.owners(), "id").select(*key, "item_id").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("hit_items"))
    per_doc = index.lengths()
    for side in (covered, named, index.near_items(gap)):
        side = side.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), *side.columns[2:])
        per_doc = per_doc.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_id", "_hash")
    listed, close = (F.coalesce(c, F.array().cast("array<string>")) for c in ("hit_items", "near_items"))
    return per_doc.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.size(listed) >= least_items).alias("contaminated"),
        F.size(close).cast("long").alias("n_near"),
        listed.alias("hit_items"),
        close.alias("near_items"),
    )


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE, least_items: int = 1) -> DataFrame:
    """The rows, with all their columns, in which windows of fewer than ``least_items`` items occur."""
    index = Index(docs.select("doc_id", "text"), items, size)
    named = index.hits().select("doc_id", "text_hash", "id").distinct().join(index.owners(), "id").groupBy("doc_id", "text_hash").agg(F.countDistinct("item_id").alias("n"))
    bad = C.written(named.filter(F.col("n") >= least_items).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    return scan(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("hit_items", "near_items")
