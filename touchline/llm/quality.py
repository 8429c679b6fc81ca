"""Operator 5: quality rules, a learned decision list over plain text statistics.

``text_stats`` computes the statistics of whole texts in one pass without a shuffle. ``learn_rules`` is sequential
covering: rules are conjunctions of thresholds, grown on two thirds of the labelled rows by information gain, pruned on
the last third, kept while they are precise there, and each removes the bad rows it covers before the next is grown.
``rule_number`` turns the list into one ordered Spark conditional expression, so applying it needs no Python.

The list is learnt from at most about ``LABELLED`` labelled ids (a hash of the id chooses them), one row each; only their
numeric statistics come to the driver. Everything else covers all rows.

Defined results: null text has no words; texts under 50 words or with more than half of their words in repeated
three-word windows fail the base rules and are not kept; without labels, or with labels of one kind only, the list is
empty and the base rules decide. Repeated rows and ids stay, row for row; of an id's labels the lowest counts. Labels
and labelled ids that are null are ignored. The columns of a result (``_q_`` before those of ``good_documents``) replace
none of the input's, of which only the named ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, table, written

#: About so many labelled rows are used for learning.
LABELLED = 50_000
#: Thresholds tried for each statistic, conditions a rule, rules a list, least precision on the pruning rows, least cover.
CUTS, CONDITIONS, RULES, PRECISION, COVER = 48, 4, 24, 0.9, 3
#: Fixed values of the contract.
SYMBOLS, MIN_WORDS, MAX_REPEAT = b"#*$%&|<>", 50, 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks"]
UPPER, DIGITS, MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?.,;:"
BLANK = b" \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a ``width``-word window found at least twice in the text, the first place included."""
    if len(words) <= width:
        return 0
    codes: dict[bytes, int] = {}
    c = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    n = len(words) - width + 1
    key = c[:n]
    for k in range(1, width):  # dense numbers of longer and longer windows
        key = np.unique(key * len(codes) + c[k : n + k], return_inverse=True)[1]
    again = (np.bincount(key) > 1)[key]
    hit = np.zeros(len(words), bool)
    for k in range(width):
        hit[k : n + k] |= again
    return int(hit.sum())


def stats(text: str | None) -> tuple[int, ...]:
    """BASE, then MORE."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, BLANK))
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.encode().strip(BLANK) if not line.isascii() else line.strip(" \t\r\x0b\x0c"):
            lines += 1
            dups += line in seen
            seen.add(line)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    return len(words), len(text) - blanks, count(SYMBOLS), dups, repeated_words(words), lines, len(set(words)), count(UPPER), count(DIGITS), count(MARKS)


def text_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """The ``keep`` columns and ``prefix`` + BASE and MORE (long), row for row."""
    names = [*(f"k{i}" for i in range(len(keep))), *BASE, *MORE]
    place = f"k{keep.index(text_col)}" if text_col in keep else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([stats(t.as_py()) for t in batch[place]], np.int64).reshape(-1, len(BASE) + len(MORE))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c) for c in found.T)], names)

    kept = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(text_col).cast("string").alias("text")] * (place == "text"))
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), *(f"{c} bigint" for c in BASE + MORE)])
    out = kept.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(prefix + c) for c in BASE + MORE])


#: What rules speak of: ratios of the statistics, so that length alone decides little.
RATIOS = {
    "symbols_a_word": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeated": ("n_repeat_words", "n_words"), "distinct": ("n_distinct_words", "n_words"),
    "word_length": ("word_chars", "n_words"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "marks_a_word": ("n_marks", "n_words"), "words_a_line": ("n_words", "n_lines"),
}


def ratios(prefix: str = "") -> dict[str, Column]:
    return {k: F.when(F.col(prefix + b) > 0, F.col(prefix + a) / F.col(prefix + b)).otherwise(0.0) for k, (a, b) in RATIOS.items()}


def base_failed(prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEAT * n)


@dataclass(frozen=True)
class Rule:
    """``conditions``: (statistic, above, threshold), all of which hold for a text the rule rejects."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, cut in self.conditions:
            v = x[:, names.index(name)]
            out &= v > cut if above else v <= cut
        return out

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, cut in self.conditions:
            out = out & (values[name] > cut if above else values[name] <= cut)
        return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[tuple[str, bool, float]]:
    """Conditions added one by one by FOIL's gain until no good row is covered or nothing is gained."""
    found: list[tuple[str, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(found) < CONDITIONS and (~bad & inside).any() and (bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        best, pick = 1e-9, None
        for k, name in enumerate(names):
            v, y = x[inside, k], bad[inside]
            cuts = np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, CUTS)), np.quantile(v[y], np.linspace(0, 1, CUTS))]))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            if not len(cuts):
                continue
            slot = np.searchsorted(cuts, v)  # v > cuts[j] where slot > j
            above_p = p - np.cumsum(np.bincount(slot[y], minlength=len(cuts) + 1))[:-1]
            above_n = n - np.cumsum(np.bincount(slot[~y], minlength=len(cuts) + 1))[:-1]
            for above, pp, nn in ((True, above_p, above_n), (False, p - above_p, n - above_n)):
                gain = pp * (np.log2(np.maximum(pp, 0.5) / np.maximum(pp + nn, 1)) - np.log2(p / (p + n)))
                j = int(np.argmax(gain))
                if gain[j] > best:
                    best, pick = gain[j], (name, above, float(cuts[j]))
        if pick is None:
            break
        found.append(pick)
        inside &= Rule((pick,), 0, 0).holds(x, names)
    return found


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], seed: int = 7) -> list[Rule]:
    """Sequential covering; ``bad`` marks the rows to reject."""
    grow = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left, rules = np.ones(len(x), bool), []
    while len(rules) < RULES and (bad & left & grow).sum() >= COVER and (~bad & grow).any():
        conditions = _grow(x[left & grow], bad[left & grow], names)
        if not conditions:
            break
        check = left & ~grow

        def worth(c: list) -> tuple[float, int]:
            hit = Rule(tuple(c), 0, 0).holds(x[check], names)
            p, n = (bad[check] & hit).sum(), (~bad[check] & hit).sum()
            return float((p - n) / max(1, p + n)), int(p)

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions = conditions[:-1]
        rule = Rule(tuple(conditions), 0, 0)
        hit = rule.holds(x, names) & left
        precision = (bad & hit & ~grow).sum() / max(1, (hit & ~grow).sum())
        if precision < PRECISION or (bad & hit).sum() < COVER:
            break
        rules.append(Rule(rule.conditions, float(precision), int((bad & hit).sum())))
        left &= ~hit
    return rules


def rule_number(rules: list[Rule], prefix: str = "") -> Column:
    """The number of the first rule that rejects a row, counted from 1; null if none does."""
    values, out = ratios(prefix), None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(values), k) if out is None else out.when(rule.column(values), k)
    return F.lit(None).cast("int") if out is None else out


def known_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled: int = LABELLED) -> DataFrame:
    """(id, y) of at most about ``labelled`` ids, one row each: the lowest of an id's labels."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    share = max(1, known.count() / labelled)
    return written(known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) / share)), "quality-labels")


def fit_rules(counted: DataFrame, known: DataFrame, id_col: str = "doc_id") -> list[Rule]:
    """Rules from counted texts (id, BASE, MORE) and ``known_labels`` (0: reject). Rows that fail the base rules teach
    nothing; of rows that share an id one teaches, the same in every run."""
    rows = counted.filter(~base_failed()).select(F.col(id_col).alias("id"), F.struct(*[v.alias(k) for k, v in ratios().items()]).alias("x"))
    one = rows.join(F.broadcast(known), "id").groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y"))  # bounded by ``labelled``
    got = one.orderBy("id").select("y", "x.*").toPandas()  # a row of numbers an id
    return learn_rules(got[list(RATIOS)].to_numpy(float), (got["y"] == 0).to_numpy(bool), list(RATIOS))


def judge(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (its number) and kept."""
    return counted.withColumn("base_failed", base_failed()).withColumn("rule", rule_number(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    counted = written(text_stats(table(spark, sf_dir, "documents"), keep=("doc_id",)), "quality-stats")
    return judge(counted, fit_rules(counted, known_labels(table(spark, sf_dir, "labels")))).select("doc_id", *BASE, "base_failed", "kept", "rule")


def good_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were. The first pass counts labelled rows only."""
    known = known_labels(labels, label_id, label_col)
    taught = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known.select("id")), "id")
    counted = written(text_stats(taught, keep=("id",)), "quality-stats")
    rules = fit_rules(counted, known, "id")
    discard(counted, known)
    marked = text_stats(docs, text_col, keep=tuple(docs.columns), prefix="_q_")
    return marked.filter(~base_failed("_q_") & rule_number(rules, "_q_").isNull()).select(*docs.columns)
