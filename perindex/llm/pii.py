"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Everything is built from Spark SQL functions. A pattern cuts a text into what it matches and
what lies between; the running lengths of both are the places of the matches. The patterns
start only where a run of their characters starts and never give back what they took, which
finds the same leftmost matches in linear time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone", "iban")
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    # A new address may also start where the last one ends.
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}


@dataclass(frozen=True)
class Rule:
    """The score of a confirmed span, and the words before it that raise the score."""

    base: float
    raised: float
    context: str


RULES = {
    "email": Rule(0.9, 1.0, "mail|contact|write|kontakt|correo|courriel"),
    "ip": Rule(0.6, 0.95, "ip|host|server|address|login"),
    "card": Rule(0.7, 1.0, "card|visa|credit|payment|karte|tarjeta|carte"),
    "phone": Rule(0.7, 1.0, "phone|call|tel|mobile|fax|telefon"),
    "iban": Rule(0.8, 1.0, "iban|bank|account|konto|cuenta|compte"),
}
#: Code points before a span in which context words count, and the least score of a reported span.
WINDOW, LEAST = 48, 0.5
#: Lengths that are added up in a row before a total is kept.
SUM_BLOCK = 128


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of a string pass the Luhn sum: from the right, each second one doubled."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d: d.try_cast("int"))
    weighed = F.transform(
        values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    )
    return F.aggregate(weighed, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    characters = F.split(moved, "")

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        digit = c.try_cast("int")
        return F.when(c == "", rest).when(digit.isNotNull(), (rest * 10 + digit) % 97).otherwise((rest * 100 + letter) % 97)

    return F.aggregate(characters, F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        number = digits(value)
        # The sum is only evaluated for a number of fitting length.
        return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(value, " ", "")).between(15, 34), mod97(value)).otherwise(False)
    return F.lit(True)


def cuts(kind: str, text: Column) -> Column:
    """``(gaps, hits)`` of a text; null if the pattern cannot match."""
    pattern = PATTERNS[kind]
    pair = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")
    )
    need = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9][0-9. -]*[0-9]")
    return F.when(need, pair)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the functions inside refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column) -> Column:
    """The sums of an array that is not empty, up to each of its places.

    A sum runs from the start of its block of ``SUM_BLOCK`` values, and blocks have the totals before
    them: the work grows with the length of the array, not with its square.
    """
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda done, x: done + x)

    def before(values: Column) -> Column:
        blocks = F.sequence(zero, F.floor((F.size(values) - 1) / SUM_BLOCK))
        totals = F.transform(blocks, lambda b: total(F.slice(values, (b * SUM_BLOCK + 1).cast("int"), F.lit(SUM_BLOCK))))
        return F.aggregate(totals, F.array(zero), lambda done, t: F.concat(done, F.array(F.element_at(done, -1) + t)))

    def sums(values: Column, before: Column) -> Column:
        def upto(_: Column, i: Column) -> Column:
            part = F.slice(values, i - i % SUM_BLOCK + 1, i % SUM_BLOCK + 1)
            return F.element_at(before, F.floor(i / SUM_BLOCK).cast("int") + 1) + total(part)

        return F.transform(values, upto)

    return bound(values, lambda v: bound(before(v), lambda b: sums(v, b)))


def candidates(kind: str, cut: Column) -> Column:
    """The matches of a pattern in order: start, end, value and what stands before each."""
    pairs = F.arrays_zip(F.slice(cut["gaps"], 1, F.size(cut["hits"])).alias("gap"), cut["hits"].alias("hit"))
    ends = running_sums(F.transform(pairs, lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("long")))
    return F.transform(
        F.arrays_zip(pairs.alias("pair"), ends.alias("end")),
        lambda x: F.struct(
            (x["end"] - F.length(x["pair"]["hit"])).alias("start"),
            x["end"].alias("end"),
            x["pair"]["hit"].alias("value"),
            F.right(x["pair"]["gap"], F.lit(WINDOW)).alias("before"),
        ),
    )


def score(kind: str, before: Column) -> Column:
    rule = RULES[kind]
    near = F.lower(before).rlike(rf"\b(?:{rule.context})")
    return F.when(near, F.lit(rule.raised)).otherwise(F.lit(rule.base))


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: structs of start, kind number, end, kind, score and value, in order.

    Places are code points, the end exclusive. A null text counts as empty. Spans of one kind
    never overlap; those of two kinds may.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    staged = docs.withColumns({f"__cut_{k}": cuts(k, whole) for k in KINDS})
    staged = staged.withColumns({f"__found_{k}": F.when(
        F.size(F.col(f"__cut_{k}.hits")) > 0, candidates(k, F.col(f"__cut_{k}"))) for k in KINDS})
    kinds = []
    for number, kind in enumerate(KINDS):
        kept = F.filter(F.col(f"__found_{kind}"), lambda s: confirmed(kind, s["value"]))
        kinds.append(F.coalesce(F.transform(kept, lambda s: F.struct(
            s["start"].alias("start"), F.lit(number).alias("number"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), score(kind, s["before"]).alias("score"), s["value"].alias("value"),
        )), F.array().cast("array<struct<start:long,number:int,end:long,kind:string,score:double,value:string>>")))
    spans = F.array_sort(F.filter(F.concat(*kinds), lambda s: s["score"] >= LEAST))
    dropped = [f"__{part}_{k}" for k in KINDS for part in ("cut", "found")]
    return staged.withColumn("spans", spans).drop(*dropped)


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, places and a digest of the personal data of every text.

    Null and empty texts have none. Repeated rows give repeated results, other columns are not
    carried, an empty table gives an empty one. Account numbers are the method's own kind.
    """
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = find_spans(slim).drop("text")
    base = F.filter("spans", lambda s: s["kind"] != "iban")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(number(k) for k in KINDS),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
        F.aggregate("spans", F.lit(0.0), lambda top, s: F.greatest(top, s["score"])).alias("top_score"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every confirmed value in ``text`` replaced by its kind in angle brackets.

    Kinds are replaced one after the other, so what overlaps a replaced span goes with it or is
    looked at again. A null text stays null; all columns stay.
    """
    out = docs
    for kind in KINDS:
        staged = out.withColumn("__cut", cuts(kind, F.col(f"`{text}`")))
        hits = F.concat(
            F.transform(F.col("__cut.hits"), lambda h: F.when(confirmed(kind, h), f"<{kind}>").otherwise(h)),
            F.array(F.lit("")),
        )
        pieces = F.transform(
            F.arrays_zip(F.col("__cut.gaps").alias("gap"), hits.alias("hit")), lambda p: F.concat(p["gap"], p["hit"])
        )
        changed = F.when(F.size(F.col("__cut.hits")) > 0, F.array_join(pieces, ""))
        out = staged.withColumn(text, F.coalesce(changed, F.col(f"`{text}`"))).drop("__cut")
    return out
