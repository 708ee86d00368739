"""Secret scans: keyword, key-id and hex patterns, and sliding-window Shannon entropy by incremental counts. Native expressions only.

The entropy scan takes candidate runs of base64 or hex letters. It keeps the counts of the characters of a window of fixed length, one
character a count, and per step changes only the counts of the character that enters and the one that leaves, and with them the running sum
of c*log2(c). A run whose highest window entropy reaches the threshold of its character class (hex digits, letters only, or mixed) is a span
of kind ``entropy``, unless the whole run is of the allow-list: a UUID, a date or number, names of words, or nothing but placeholder words.

Nulls: a null text is the empty text; a null doc_id stays. Repeated rows each give a row, ties of the start go by kind. Empty tables give
empty results; columns other than doc_id and the text are left aside, whatever they are called. Long texts and long runs take time in
proportion to their length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnlake.llm import common as C

#: Fixed values.
KINDS = ("assign", "access", "hex", "entropy")
BASE = KINDS[:3]
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "entropy": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
GUARDS = {
    "assign": lambda t: (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & t.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]"""),
    "access": lambda t: F.contains(t, F.lit("AKIA")),
    "hex": lambda t: t.rlike(r"[0-9a-f]{24}"),
    "entropy": lambda t: t.rlike(r"[A-Za-z0-9+/_-]{20}"),
}
#: Window length, and the least entropy in bits a character by class of the run.
WINDOW, BITS = 20, {"hex": 2.9, "letters": 4.0, "mixed": 3.6}
#: Runs that are known not to be secrets. Each pattern is of the whole run, so a known word inside a longer run frees nothing.
ALLOW = (
    r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",  # UUIDs
    r"[0-9+/_-]++",  # numbers, dates
    r"[/_-]*+(?:[a-z]++[/_-]++)++[a-z]*+[0-9]{0,4}[/_-]*+",  # names of lower-case words
    r"(?:[A-Z]++[/_-]++)++[A-Z]*+[0-9]{0,4}",  # constants
    r"[/_-]*+(?:[A-Z]?+[a-z]{3,}+[/_-]*+)++[0-9]{0,4}",  # names in camel case
    r"(?i:example|sample|dummy|placeholder|changeme|test|your|my|here|insert|api|access|key|token|secret|password|abcdefghijklmnopqrstuvwxyz|0123456789|1234567890|123456|x{3,}+|0{3,}+|[/+_=-]++)++",
)
#: The characters of a run; a window's count of the n-th stands as a character at the n-th place, counted from ZERO.
LETTERS, ZERO = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 65


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of any window of that many characters; of the whole run where it is shorter."""
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    term = lambda c: F.get(terms, F.greatest(c, F.lit(0)))
    count = lambda counts, place: F.ascii(F.substring(counts, place, F.lit(1))) - ZERO
    put = lambda counts, place, n: F.overlay(counts, F.char(n + ZERO), place, F.lit(1))

    def scan(letters: Column) -> Column:
        width = F.least(F.lit(window), F.size(letters))

        def step(acc: Column, i: Column) -> Column:
            came = F.position(F.get(letters, i), F.lit(LETTERS))
            left = F.when(i >= window, F.position(F.get(letters, i - window), F.lit(LETTERS))).otherwise(F.lit(0))

            def changed(x: Column) -> Column:
                total = acc["t"] + F.when(
                    x["a"] != x["b"],
                    term(x["n"] + 1) - term(x["n"]) + F.when(x["b"] > 0, term(x["m"] - 1) - term(x["m"])).otherwise(0.0),
                ).otherwise(0.0)
                entered = put(acc["n"], x["a"], x["n"] + 1)
                counts = F.when(x["a"] == x["b"], acc["n"]).when(x["b"] > 0, put(entered, x["b"], x["m"] - 1)).otherwise(entered)
                return F.struct(counts.alias("n"), total.alias("t"))

            places = F.struct(came.alias("a"), left.alias("b"))
            known = C.let(places, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), count(acc["n"], x["a"]).alias("n"), count(acc["n"], x["b"]).alias("m")))
            return C.let(
                C.let(known, changed),
                lambda x: F.struct(x["n"].alias("n"), x["t"].alias("t"), F.when(i + 1 >= width, F.least(acc["low"], x["t"])).otherwise(acc["low"]).alias("low")),
            )

        start = F.struct(F.lit(chr(ZERO) * len(LETTERS)).alias("n"), F.lit(0.0).alias("t"), F.lit(1e9).alias("low"))
        return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), start, step, lambda acc: F.log2(width.cast("double")) - acc["low"] / width)

    return C.let(F.split(run, ""), scan)


def _kept(kind: str, x: Column) -> Column:
    if kind == "assign":
        value = F.regexp_extract(x["m"], r"""^(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)$""", 1)
        return F.length(value) >= 6
    if kind in ("access", "hex"):
        return F.length(x["m"]) >= {"access": 20, "hex": 24}[kind]
    bits = F.when(x["m"].rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), BITS["hex"]).when(x["m"].rlike("^[A-Za-z]+$"), BITS["letters"]).otherwise(BITS["mixed"])
    return ~x["m"].rlike(f"^(?:{'|'.join(ALLOW)})$") & (window_entropy(x["m"]) >= bits)


def _confirmed(kind: str) -> Column:
    return F.filter(F.col(f"_raw_{kind}"), lambda x: _kept(kind, x))


def find_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds an array of spans for each kind, as ``_<kind>``."""
    out = df.withColumn("_text", C.text_of(df, text))
    for kind in KINDS:
        out = out.withColumn(f"_raw_{kind}", C.match_spans(F.col("_text"), PATTERNS[kind], GUARDS[kind](F.col("_text"))))
    for kind in KINDS:
        kept = _confirmed(kind)
        out = out.withColumn(f"_{kind}", F.when(F.size(f"_raw_{kind}") > 0, kept).otherwise(F.col(f"_raw_{kind}"))).drop(f"_raw_{kind}")
    return out


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with counts, digest and list of its secrets."""
    found = find_spans(df.select("doc_id", text), text)
    base = F.concat(*(C.tagged(F.col(f"_{k}"), k, i) for i, k in enumerate(BASE)))
    every = F.concat(*(C.tagged(F.col(f"_{k}"), k, i) for i, k in enumerate(KINDS)))
    return (
        found.withColumn("_base", C.joined(base))
        .withColumn("spans", C.joined(every))
        .select("doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE), F.sha2("_base", 256).alias("base_sha256"), "spans", F.size("_entropy").cast("long").alias("n_entropy"))
    )


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return scan(C.table(spark, sf_dir, "documents"))
