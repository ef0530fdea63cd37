"""Quality rules with risk-controlled cutoffs.

A base filter drops texts of fewer than 20 words, or with over 30 % of the words in repeated
8-word windows.  On top of it, each rule rejects values above a cutoff that is chosen per
stratum (language) from labelled holdout rows: walking a fixed grid from lenient to strict,
a cutoff stands while the exact (Clopper-Pearson) upper bound on the share of good documents
that it rejects stays within the allowed risk.  The error level is divided over all pairs of
stratum and rule (Bonferroni), the allowed risk over the rules; along the grid a fixed test
sequence needs no further correction.  A stratum with too few labels gets no cutoff, so
nothing is rejected there without evidence.

Null texts have no words and fail the base filter.  Null labels and ids match nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, apart, small, stash, table, with_columns

WINDOW = 8
#: False rejection of good documents allowed per stratum, and the chance that the guarantee fails anywhere.
RISK, DELTA = 0.01, 0.05
SYMBOLS = b"#*$%&|<>"
#: Rule, expression over the base columns, and the geometric grid (first cutoff, ratio, number).
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 0.002, 1.25, 30),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.01, 1.2, 26),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.005, 1.2, 24),
    "long_words": ("word_chars / greatest(n_words, 1)", 4.0, 1.05, 40),
}
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words inside windows of ``k`` words that occur twice or more."""
    n = len(words)
    if n <= k:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == n:
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    m = n - k + 1
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x100000001B3) + mixed[j : m + j]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate(([False], s[1:] == s[:-1], [False]))
    starts = order[same[1:] | same[:-1]]
    if not len(starts):
        return 0
    seen: dict[tuple, int] = {}  # the windows themselves decide, not their hashes
    for i in starts.tolist():
        w = tuple(ids[i : i + k].tolist())
        seen[w] = seen.get(w, 0) + 1
    covered = np.zeros(n + 1, np.int64)
    for i in starts.tolist():
        if seen[tuple(ids[i : i + k].tolist())] > 1:
            covered[i] += 1
            covered[i + k] -= 1
    return int((np.cumsum(covered[:n]) > 0).sum())


def base_counts(text: bytes | None) -> tuple[int, ...]:
    """Words, code points in words, symbols, duplicate lines, repeated words, lines with a word."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    words = text.split()
    seen, lines, dup = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (len(words), len(b"".join(words).decode("utf-8", "replace")), symbols, dup, repeated_words(words), lines)


def with_base(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` and the base columns, their names led by ``prefix``, which must keep them apart from those of ``docs``."""
    names = [f"{prefix}{p.split()[0]}" for p in BASE.split(", ")]
    if apart(docs, *names) != names:
        raise ValueError(f"docs has a column of {names}: give a prefix")
    schema = ", ".join(f"`{prefix}{p.split()[0]}` long" for p in BASE.split(", "))
    return with_columns(docs, text, schema, lambda texts: list(map(list, zip(*map(base_counts, texts), strict=True))) if texts else [[] for _ in BASE.split(", ")])


def _named(expression: str, prefix: str) -> str:
    for p in BASE.split(", "):
        expression = expression.replace(p.split()[0], f"`{prefix}{p.split()[0]}`")
    return expression


def base_failed(prefix: str = ""):
    return F.expr(_named("n_words < 20 or 100 * n_repeat_words > 30 * n_words", prefix))


def grid(rule: str) -> list[float]:
    _, first, ratio, n = RULES[rule]
    return [first * ratio**i for i in range(n)]


def upper_bound(rejected: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a binomial share: the p at which P(X <= rejected) is ``level``."""
    if n == 0 or rejected >= n:
        return 1.0

    def tail(p: float) -> float:
        first = n * math.log1p(-p)
        term, total = 0.0, 0.0
        logs = []
        for i in range(rejected + 1):
            logs.append(first + term)
            term += math.log((n - i) / (i + 1)) + math.log(p) - math.log1p(-p)
        top = max(logs)
        total = sum(math.exp(x - top) for x in logs)
        return math.exp(top) * total if top > -700 else 0.0

    lo, hi = rejected / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid in (0.0, 1.0) or tail(mid) > level:
            lo = mid
        else:
            hi = mid
    return hi


def choose(good: list[int], cutoffs: list[float], risk: float, level: float) -> float | None:
    """The strictest cutoff of the fixed sequence that stands.  ``good[i]``: good rows whose value exceeds just ``i`` cutoffs."""
    n, chosen, above = sum(good), None, 0
    for i in reversed(range(len(cutoffs))):
        above += good[i + 1]
        if above > n * risk or upper_bound(above, n, level) > risk:
            break
        chosen = cutoffs[i]
    return chosen


def cutoffs(base: DataFrame, labels: DataFrame, stratum: str, prefix: str = "") -> DataFrame:
    """``(stratum, rule, cutoff)`` from the labelled rows of ``base`` that pass the base filter.

    Rows are counted by stratum, rule and grid cell before the shuffle; each pair of stratum
    and rule then is a group of at most one row for each grid cell.
    """
    marks = labels.filter("quality = 1").select("doc_id").distinct()
    narrow = base.select("doc_id", stratum, *[f"`{prefix}{p.split()[0]}`" for p in BASE.split(", ")])
    good = narrow.filter(~base_failed(prefix)).join(marks, "doc_id", "left_semi")
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), sum((F.expr(_named(RULES[r][0], prefix)) > c).cast("int") for c in grid(r)).alias("cell")) for r in RULES])
    counted = stash(good.select(F.coalesce(F.col(stratum).cast("string"), F.lit("und")).alias("stratum"), F.explode(cells).alias("x")).groupBy("stratum", "x.rule", "x.cell").agg(F.count(F.lit(1)).alias("n")), "quality-cells")
    tests = counted.select("stratum", "rule").distinct().count()
    risk, level = RISK / len(RULES), DELTA / max(tests, 1)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rule = pdf["rule"].iloc[0]
        cuts = grid(rule)
        good = [0] * (len(cuts) + 1)
        for cell, n in zip(pdf["cell"], pdf["n"], strict=True):
            good[int(cell)] += int(n)
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "rule": [rule], "cutoff": [choose(good, cuts, risk, level)]})

    return counted.groupBy("stratum", "rule").applyInPandas(pick, "stratum string, rule string, cutoff double")


def chosen_cutoffs(base: DataFrame, labels: DataFrame, stratum: str, prefix: str, made: str) -> DataFrame:
    """One row a stratum: its name (``made`` + stratum) and a cutoff column (``made`` + rule) for each rule."""
    wide = cutoffs(base, labels, stratum, prefix).groupBy("stratum").pivot("rule", list(RULES)).agg(F.max("cutoff"))
    return stash(wide.select(*[F.col(c).alias(f"{made}{c}") for c in ("stratum", *RULES)]), "quality-cutoffs")


def judged(base: DataFrame, labels: DataFrame, stratum: str, prefix: str, made: str) -> tuple[DataFrame, Column]:
    """``base`` with its stratum's cutoffs, and whether a row is over one of them."""
    chosen = chosen_cutoffs(base, labels, stratum, prefix, made)
    joined = base.join(small(chosen, 10_000), F.coalesce(F.col(stratum).cast("string"), F.lit("und")) == F.col(f"{made}stratum"), "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.expr(_named(RULES[r][0], prefix)) > F.col(f"{made}{r}"), F.lit(False))
    return joined, over


def verdicts(base: DataFrame, labels: DataFrame, stratum: str = "lang", prefix: str = "", made: str = "") -> DataFrame:
    """``base`` and the columns ``base_failed`` and ``kept``, their names led by ``made`` (and by underscores where ``base`` has them)."""
    failed, kept = apart(base, f"{made}base_failed", f"{made}kept")
    joined, over = judged(base, labels, stratum, prefix, fresh("_cut_", base))
    return joined.select(*base.columns, base_failed(prefix).alias(failed), (~base_failed(prefix) & ~over).alias(kept))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base filter and the chosen cutoffs, with the same columns.

    Texts are read and counted once and written beside their counts; the cutoffs come from the
    narrow columns of that table, and no text is shuffled.
    """
    prefix = fresh("_q_", docs)
    whole = stash(with_base(docs, "text", prefix), "quality-base")
    joined, over = judged(whole, labels, "lang", prefix, fresh("_cut_", whole))
    return joined.filter(~base_failed(prefix) & ~over).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    base = stash(with_base(docs.select("doc_id", "lang", "text")).drop("text"), "quality-base")
    return verdicts(base, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang")
