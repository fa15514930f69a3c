"""Quality rules learned as a decision list of threshold conjunctions.

Sequential covering on labelled statistics: a rule for bad documents grows test by test on two
thirds of the sample, always by the test of the best information gain; it loses tests at its end
while that helps on the last third; the rows it covers leave, and the next rule is grown. The
list becomes one ordered Spark expression of the statistics.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perindex.llm.text_batches import map_columns, whole_text

SYMBOLS = b"#*$%&|<>"
#: Labelled rows to learn from, at most on average; the sample is by hash, so it is the same each time.
SAMPLE = 20_000
#: Thresholds tried for each statistic, tests in a rule, rules in the list.
CUTS, TESTS, RULES = 32, 4, 16
#: A rule stays only if this share of what it covers in the pruning third is bad, or more.
PRECISION = 0.9

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
EXTRA = "n_distinct long, n_lines long, n_upper long, n_digits long, n_marks long, longest long"
#: The statistics that rules test, as SQL expressions of the counts.
RATIOS = {
    "words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "longest": "double(longest)",
}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(windows) < 2:
        return 0
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered, reach = 0, 0  # words before ``reach`` have been counted
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered += at + 3 - max(at, reach)
            reach = at + 3
    return covered


def text_counts(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()  # bytes split at the six ASCII spaces only
    lines = [line for line in data.split(b"\n") if line.strip()]
    spaces = len(data) - len(data.translate(None, b" \t\n\v\f\r"))
    return (
        len(words),
        len(text) - spaces,
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(set(words)),
        len(lines),
        len(data) - len(data.translate(None, bytes(range(65, 91)))),
        len(data) - len(data.translate(None, b"0123456789")),
        len(data) - len(data.translate(None, b".,;:!?")),
        max(map(len, words), default=0),
    )


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts of every text; a null or empty one has zeros. Other columns are not carried."""
    schema = f"{COUNTS}, {EXTRA}"
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def make():
        def counted(keys: list[int], texts: list[str]) -> dict[str, list]:
            rows = [(key, *text_counts(t)) for key, t in zip(keys, texts, strict=True)]
            return dict(zip(names, map(list, zip(*rows, strict=True)) if rows else [[]] * len(names), strict=True))

        return counted

    return map_columns(docs, [F.col(f"`{doc_id}`").cast("long"), whole_text(text)], make, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """One threshold: the statistic is at most, or above, the value."""

    name: str
    above: bool
    value: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] > self.value if self.above else table[self.name] <= self.value

    def column(self) -> Column:
        value = F.expr(RATIOS[self.name])
        return value > self.value if self.above else value <= self.value


Rule = tuple[Test, ...]


def covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    size = len(next(iter(table.values())))
    return reduce(np.logical_and, (t.holds(table) for t in rule), np.ones(size, bool))


def grow(table: dict[str, np.ndarray], bad: np.ndarray, tests: list[Test]) -> Rule:
    rule: Rule = ()
    covered = np.ones(len(bad), bool)
    while len(rule) < TESTS and (covered & ~bad).any():
        was = np.log2((covered & bad).sum() / covered.sum())
        best, gain = None, 0.0
        for test in tests:
            now = covered & test.holds(table)
            hits = (now & bad).sum()
            if hits and (worth := hits * (np.log2(hits / now.sum()) - was)) > gain + 1e-9:
                best, gain = test, worth
        if best is None:
            break
        rule, covered = (*rule, best), covered & best.holds(table)
    return rule


def precision(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> float:
    covered = covers(rule, table)
    return (covered & bad).sum() / covered.sum() if covered.any() else 0.0


def learn(table: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> list[Rule]:
    """The ordered rules for bad rows; ``prune`` marks the rows kept for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    points = np.linspace(0, 1, CUTS + 2)[1:-1]
    while len(rules) < RULES:
        growing, pruning = left & ~prune, left & prune
        if not (bad & growing).any() or not (bad & pruning).any():
            break
        mine = {k: v[growing] for k, v in table.items()}
        tests = [
            Test(name, above, float(value))
            for name, column in mine.items()
            for value in np.unique(np.concatenate([np.quantile(column, points), np.quantile(column[bad[growing]], points)]))
            for above in (False, True)
        ]
        rule = grow(mine, bad[growing], tests)
        other = {k: v[pruning] for k, v in table.items()}

        def worth(r: Rule, other: dict = other, truth: np.ndarray = bad[pruning]) -> float:
            covered = covers(r, other)
            return ((covered & truth).sum() - (covered & ~truth).sum()) / max(1, covered.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule or precision(rule, other, bad[pruning]) < PRECISION:
            break
        rules.append(rule)
        left &= ~covers(rule, table)
    return rules


def sampled(labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, int]:
    """Labelled ids with their worst label, at most about ``sample`` of them, and how many there are in all."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = known.count()
    share = min(1.0, sample / max(1, total))
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1), total


def learn_from(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from labelled rows: quality 0 is bad. Repeated labels of a document count once, the worst of them.

    Rows that repeat an id are one row with the least of each statistic, so at most about ``sample``
    rows come to the driver, always the same ones. Without labels of both kinds there are no rules.
    """
    chosen, _ = sampled(labels, sample)
    rows = (
        stats.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(*(F.min(F.expr(c)).alias(n) for n, c in RATIOS.items()))
        .collect()
    )
    rows.sort(key=lambda r: tuple(r))
    if len({r["quality"] == 0 for r in rows}) < 2:
        return []
    table = {n: np.array([r[n] for r in rows], float) for n in RATIOS}
    bad = np.array([r["quality"] == 0 for r in rows])
    prune = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 for r in rows])
    return learn(table, bad, prune)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, from 1, or null: an ordered Spark expression."""
    steps = [(reduce(Column.__and__, (t.column() for t in rule)), k + 1) for k, rule in enumerate(rules)]
    if not steps:
        return F.lit(None).cast("int")
    return reduce(lambda out, step: out.when(step[0], step[1]), steps[1:], F.when(*steps[0]))


def kept_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that the base rules or the learned list reject; all columns stay.

    The rules are learned from the labelled documents among ``docs``; nothing is shuffled but the
    labels.
    """
    names = [part.split(" ")[0] for part in f"{COUNTS}, {EXTRA}".split(", ")][1:]

    @F.pandas_udf(f"{COUNTS}, {EXTRA}".removeprefix("doc_id long, "))
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=names, dtype="int64")

    labelled = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("body"))
    known, _ = sampled(labels)
    sample = labelled.join(F.broadcast(known), "doc_id", "left_semi")
    rules = learn_from(statistics(sample, text="body"), labels)
    marked = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), counted(whole_text(text)).alias("counts")
    ).select("doc", "counts.*")
    return marked.filter(~base_failed() & verdict(rules).isNull()).select("doc.*")


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts, the base verdict, the rule that rejects a document, and whether it is kept."""
    return (
        stats.withColumn("base_failed", base_failed())
        .withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
        .select(*(p.split(" ")[0] for p in COUNTS.split(", ")), "base_failed", "kept", "rule")
    )
