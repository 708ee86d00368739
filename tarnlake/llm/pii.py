"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score. Native expressions only.

The score of a span is its kind's, plus BOOST where a context word stands within WINDOW code points before it, or after it and before the
next span of its kind. Kinds beyond the base ones are spans only from the threshold on; ``scored`` lists all spans with their scores.

Nulls: a null text is the empty text (no spans); a null doc_id stays. Repeated rows each give a row; ties of the start go by kind. Empty
tables give empty results. Extra columns, whatever they are called, are left aside by :func:`scan` and kept by :func:`redact`. Quantifiers are
possessive and runs are entered at their start only, so very long texts, and texts of very many spans, take time in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnlake.llm import common as C

#: Kinds in the order that breaks ties of the start. The first four are the base ones.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "passport")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "passport": r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])",
}
#: What a text must hold to be searched at all.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "passport": lambda t: t.rlike(r"[A-Z][0-9]{6}"),
}
#: Score of a confirmed span, and what a context word in the WINDOW code points around it adds. Without a checksum a pattern says little.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.35, "passport": 0.25}
CONTEXT = {
    "email": r"(?i)\b(e-?mail|contact|write to)\b",
    "ip": r"(?i)\b(ip|host|server|address)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(iban|account|bank)\b",
    "ssn": r"(?i)\b(ssn|social security|tax id)\b",
    "passport": r"(?i)\b(passport|travel document)\b",
}
BOOST, WINDOW, THRESHOLD = 0.3, 48, 0.5


def _confirmed(kind: str, m: Column) -> Column:
    digits = C.digits_of(m)
    if kind == "ip":
        return F.forall(F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(12, 19) & C.luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        code = F.replace(m, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & (C.mod97(code) == 1)
    return F.lit(True)


def _scored(kind: str, threshold: float) -> Column:
    """The confirmed ones of ``_raw_<kind>`` with their scores; of kinds beyond the base those that reach the threshold."""

    def score(x: Column) -> Column:
        boost = F.when(x["before"].rlike(CONTEXT[kind]) | x["after"].rlike(CONTEXT[kind]), BOOST).otherwise(0.0)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), (F.lit(SCORES[kind]) + boost).alias("score"))

    scored = F.transform(F.filter(F.col(f"_raw_{kind}"), lambda x: _confirmed(kind, x["m"])), score)
    return scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= threshold)


def find_spans(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``_found``: per kind an array of struct s, e, m, score of confirmed spans; kinds beyond the base need the threshold."""
    out = df.withColumn("_text", C.text_of(df, text))
    for kind in KINDS:
        out = out.withColumn(f"_raw_{kind}", C.match_spans(F.col("_text"), PATTERNS[kind], GUARDS[kind](F.col("_text")), WINDOW))
    for kind in KINDS:
        kept = _scored(kind, threshold)
        out = out.withColumn(f"_{kind}", F.when(F.size(f"_raw_{kind}") > 0, kept).otherwise(F.array().cast("array<struct<s:int,e:int,m:string,score:double>>"))).drop(f"_raw_{kind}")
    return out


def _scored_span(kind: str, rank: int):
    """A tagged span whose kind carries the score, for kind=score:start:end."""
    return lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.format_string(f"{kind}=%.2f", x["score"]).alias("kind"))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with counts, digest and list of its personal data."""
    found = find_spans(df.select("doc_id", text), text)
    base = F.concat(*(C.tagged(F.col(f"_{k}"), k, i) for i, k in enumerate(BASE)))
    every = F.concat(*(C.tagged(F.col(f"_{k}"), k, i) for i, k in enumerate(KINDS)))
    return (
        found.withColumn("_base", C.joined(base))
        .withColumn("spans", C.joined(every))
        .select(
            "doc_id",
            *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE),
            F.sha2("_base", 256).alias("base_sha256"),
            "spans",
            *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[4:]),
            F.array_max(F.transform(F.concat(*(F.col(f"_{k}") for k in KINDS)), lambda x: x["score"])).alias("top_score"),
            C.joined(F.concat(*(F.transform(F.col(f"_{k}"), _scored_span(k, i)) for i, k in enumerate(KINDS)))).alias("scored"),
        )
    )


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in angle brackets; of overlapping spans the one that starts first stands for all."""
    found = find_spans(df.select(F.struct(*(df[c] for c in df.columns)).alias("_row"), df[text].alias("_given")), "_given")
    every = F.array_sort(F.concat(*(C.tagged(F.col(f"_{k}"), k, i) for i, k in enumerate(KINDS))))
    kind = "struct<s:int,e:int,kind:string>"

    def merged(spans: Column) -> Column:
        """Disjoint stretches: a span that starts before the end of those before it lengthens them. The last state of each is its end."""

        def step(state: Column, x: Column) -> tuple[Column, Column]:
            fresh = x["s"] >= state["e"]
            begin, end = F.when(fresh, x["s"]).otherwise(state["s"]), F.greatest(state["e"], x["e"])
            name = F.when(fresh, x["kind"]).otherwise(state["kind"])
            now = F.struct(begin.alias("s"), end.alias("e"), name.alias("kind"))
            return now, now

        states = C.running(spans, F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("kind")), step, kind)
        return C.let(states, lambda all_: F.filter(all_, lambda x, i: F.coalesce(F.get(all_, i + 1)["s"] != x["s"], F.lit(True))))

    def cleaned(spans: Column) -> Column:
        around = C.pieces_around(F.col("_text"), spans)
        return F.array_join(F.transform(F.arrays_zip(around.alias("p"), spans.alias("x")), lambda z: F.concat(z["p"], F.coalesce(F.concat(F.lit("<"), z["x"]["kind"], F.lit(">")), F.lit("")))), "")

    new = F.when(F.size("_every") > 0, C.let(merged(F.col("_every")), cleaned)).otherwise(F.col("_given"))
    return found.withColumn("_every", every).select(*(new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return scan(C.table(spark, sf_dir, "documents"))
