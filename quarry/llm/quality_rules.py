"""Quality rules: text statistics and a learned decision list over them.

Statistics come from one vectorised pass over whole texts.  The decision list
is learned on the driver from a bounded sample of labelled rows
(``max_labelled``) by sequential covering: a rule is grown on two thirds of the
rows as a conjunction of thresholds by information gain, pruned on the last
third, and kept while it stays precise; its rows leave and the next rule is
grown.  The list is emitted as one ordered ``CASE WHEN`` column, so scoring is
plain Spark SQL.

Defined results: null or empty text has no words, all statistics 0 and fails
the base rule; one very long text is walked in bounded spans; equal rows get
equal answers; without labels (or with one class only) the list is empty and
only the base rule rejects; the input row travels in the struct ``doc`` so
that column names cannot clash; labels with a null id are left out and of
several labels of an id the lowest holds; of rows that repeat a labelled id one
is learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.staging import small_arrow_batches
from quarry.llm.textkit import WHITE, slices, string_buffers, window_hashes, word_hashes, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_STRIP = b" \t\n\x0b\x0c\r"


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:]] |= same
    flag[order[:-1]] |= same
    return flag


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of every text of a string column."""
    raw_all, bounds_all = string_buffers(column)
    parts: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
    for at, to in slices(bounds_all):
        raw, bounds = raw_all[bounds_all[at] : bounds_all[to]], bounds_all[at : to + 1] - bounds_all[at]
        starts, ends, first = word_spans(raw, bounds)
        sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[bounds])  # noqa: E731, B023
        per_text = np.diff(first)
        parts["n_words"].append(per_text)
        parts["word_chars"].append(sums(~WHITE[raw] & ((raw & 0xC0) != 0x80)))
        parts["n_symbols"].append(sums(_SYMBOL[raw]))
        parts["n_upper"].append(sums(_UPPER[raw]))
        parts["n_digits"].append(sums(_DIGIT[raw]))
        lines, dups = np.zeros(to - at, np.int64), np.zeros(to - at, np.int64)
        data = raw.tobytes()
        for i in range(to - at):
            own = data[bounds[i] : bounds[i + 1]].split(b"\n")
            lines[i] = len(own)
            if len(own) > 1:
                worded = [x for x in own if x.strip(_STRIP)]
                dups[i] = len(worded) - len(set(worded))
        parts["n_lines"].append(lines)
        parts["n_dup_lines"].append(dups)
        words = word_hashes(raw, starts, ends, lower=False)
        text_of = np.repeat(np.arange(to - at), per_text)
        salt = (text_of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        covered = np.zeros(len(words), bool)
        windows = window_hashes(words, 3)
        if len(windows):
            inside = np.flatnonzero(text_of[:-2] == text_of[2:])
            again = inside[_repeated(windows[inside] ^ salt[inside])]
            for k in range(3):
                covered[again + k] = True
        parts["n_repeat_words"].append(np.diff(np.concatenate(([0], np.cumsum(covered)))[first]))
        distinct = np.unique(words ^ salt, return_index=True)[1] if len(words) else np.zeros(0, np.int64)
        parts["n_distinct_words"].append(np.bincount(text_of[distinct], minlength=to - at))
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in parts.items()}


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = text_counts(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[c]) for c in COUNTS)], names=["doc", *COUNTS])


def quality_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc struct of ``keep`` or all columns, COUNTS) for every row."""
    small_arrow_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("doc"), docs[text].cast("string").alias("_text"))
    schema = T.StructType([T.StructField("doc", packed.schema["doc"].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return packed.mapInArrow(_count_batches, schema)


#: Interpretable statistics of the rules, as (numerator, denominator) counts; "" is 1.
STATISTICS = {
    "words": ("n_words", ""),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "distinct_word_share": ("n_distinct_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def statistic(name: str) -> Column:
    """The statistic as a Spark column over COUNTS (0 where its denominator is 0)."""
    top, bottom = STATISTICS[name]
    if not bottom:
        return F.col(top).cast("double")
    return F.when(F.col(bottom) > 0, F.col(top).cast("double") / F.col(bottom).cast("double")).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = statistic(self.statistic)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, bool)
    for c in rule:
        mask &= values[c.statistic] > c.threshold if c.above else values[c.statistic] <= c.threshold
    return mask


def _centred(c: Condition, seen: np.ndarray) -> Condition:
    """The same split of the rows seen, with the threshold half way between the values it parts."""
    below, over = seen[seen <= c.threshold], seen[seen > c.threshold]
    if not len(below) or not len(over):
        return c
    return Condition(c.statistic, c.above, float((below.max() + over.min()) / 2))


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], max_conditions: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        base, best, pick = math.log2(p0 / (p0 + n0)), 1e-9, None
        for name, thresholds in cuts.items():
            ranked = np.sort(values[name][inside & bad]), np.sort(values[name][inside & ~bad])
            low_p, low_n = (np.searchsorted(r, thresholds, side="right") for r in ranked)
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
                k = int(np.argmax(gain)) if len(gain) else -1
                if k >= 0 and gain[k] > best:
                    best, pick = float(gain[k]), Condition(name, above, float(thresholds[k]))
        if pick is None:
            break
        pick = _centred(pick, values[pick.statistic][inside])
        rule.append(pick)
        inside &= _holds((pick,), values, len(bad))
    return tuple(rule)


def _precision(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    mask = _holds(rule, values, len(bad))
    p, n = int((mask & bad).sum()), int((mask & ~bad).sum())
    return (p + 1) / (p + n + 2), p


def learn_decision_list(values: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_cover: int = 3, seed: int = 7) -> list[Rule]:
    """Sequential covering: ordered conjunctions that predict a bad text."""
    part = np.random.default_rng(seed).integers(0, 3, len(bad))
    grow, prune = part != 0, part == 0
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, 65), method="nearest")) if len(v) else v for k, v in values.items()}
    rules: list[Rule] = []
    while len(rules) < max_rules:
        pick = lambda m: {k: v[m] for k, v in values.items()}
        if not bad[grow].any():
            break
        rule = _grow(pick(grow), bad[grow], cuts, max_conditions)
        if not rule:
            break
        held = pick(prune)
        while len(rule) > 1:
            shorter = [rule[:i] + rule[i + 1 :] for i in range(len(rule))]
            best = max(shorter, key=lambda r: _precision(r, held, bad[prune])[0])  # noqa: B023
            if _precision(best, held, bad[prune])[0] < _precision(rule, held, bad[prune])[0]:
                break
            rule = best
        every = grow | prune
        score, cover = _precision(rule, pick(every), bad[every])
        if score < min_precision or cover < min_cover:
            break
        rules.append(rule)
        gone = _holds(rule, values, len(bad))
        grow, prune = grow & ~gone, prune & ~gone
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one column: the first rule that holds rejects, else the text is kept."""
    out: Column | None = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def fit_rules(docs: DataFrame, labels: DataFrame, text: str = "text", max_labelled: int = 20000) -> list[Rule]:
    """Learn the list from at most ``max_labelled`` labelled rows, taken by hash of the id."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    # max_labelled bounds the broadcast side.
    joined = docs.select("doc_id", docs[text].alias("_text")).join(F.broadcast(sample), "doc_id")
    counted = quality_stats(joined, "_text", ["doc_id", "quality"]).select("doc.doc_id", "doc.quality", *COUNTS)
    # Of rows that repeat an id one is learned from, so max_labelled bounds what the driver gets.
    rows = counted.groupBy("doc_id").agg(F.min(F.struct("quality", *COUNTS)).alias("row")).select("doc_id", "row.*").toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
    counts = {c: rows[c].to_numpy(np.float64) for c in COUNTS}
    values = {}
    for name, (top, bottom) in STATISTICS.items():
        under = counts[bottom] if bottom else np.ones(len(rows))
        values[name] = np.where(under > 0, counts[top] / np.where(under > 0, under, 1), 0.0)
    # The base rule rejects by itself; the list learns from what is left.
    left = ~((counts["n_words"] < 50) | (counts["n_repeat_words"] * 100 > counts["n_words"] * 50))
    return learn_decision_list({k: v[left] for k, v in values.items()}, (rows["quality"].to_numpy() == 0)[left])


def quality_filter(docs: DataFrame, labels: DataFrame, text: str = "text", keep: list[str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """(doc, COUNTS, base_failed, kept) for every row of ``docs``."""
    rules = fit_rules(docs, labels, text) if rules is None else rules
    failed = base_failed()
    return quality_stats(docs, text, keep).withColumn("base_failed", failed).withColumn("kept", F.when(failed, F.lit(False)).otherwise(verdict(rules)))
