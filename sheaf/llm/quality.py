"""Quality rules whose cutoffs hold a bound on false rejections.

A rule rejects a text whose measure exceeds a cutoff. The rules' cutoffs form one ladder, the most lenient step first; a step
has a cutoff for every rule. Labelled good documents are the holdout: for each stratum (language) the steps are tested in order,
and the last one stands whose false rejections by any rule among n good documents, k, pass the exact binomial test: were the
true rate `risk` or more, k or fewer would be seen with probability `level` at most.

Correction: a step stands for all rules together, so these need none. Along a ladder the tests are a fixed sequence, which stops
at the first failure and so needs none either. Over strata it is Holm's, for sequences: each begins with an equal part of
`error`, and one that has passed its whole ladder leaves its part to the others. Hence with probability 1 - error every stratum's
rules together falsely reject at most a share `risk`. With the defaults and four strata 86 good labels are the fewest
that can pass a step; a stratum with fewer gets no cutoffs and rejects nothing.

A null or empty text has no words, fails the base rules, and is not kept. A null language is a stratum of
its own. Repeated rows keep a row each, but a label counts once: rows that repeat a labelled id are one trial of the
holdout, the first by language and measures. A document is good only if all its labels say so. A measure equal to
a cutoff is not above it. Very long texts are measured whole, one at a time. An empty table gives an empty report; without labels
only the base rules reject. Columns besides doc_id, text, lang and quality are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, id_again, id_of, text_of

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Each rule's measure and its grid of cutoffs, the most lenient first.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1),
    "upper_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "dup_line_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1),
    "exclamations_per_word": (1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1),
    "word_length": (40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0),
}
#: The ladder: each step has a cutoff for every rule; a rule whose grid is at its end stays there.
LADDER: list[dict[str, float]] = [{rule: grid[min(i, len(grid) - 1)] for rule, grid in RULES.items()} for i in range(max(map(len, RULES.values())))]


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of so many words that occur twice or more in the text, the first occurrence included."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    ids = codes[: n + window - 1].astype(np.int64)
    ranks = ids[:n]
    for i in range(1, window):  # exact: each step numbers the distinct prefixes anew
        _, ranks = np.unique(ranks * (int(ids.max()) + 1) + ids[i : i + n], return_inverse=True)
    counts = np.bincount(ranks)
    starts = np.nonzero(counts[ranks] > 1)[0]
    covered = np.zeros(len(codes) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measures(text: str) -> tuple:
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    if n > WINDOW:
        table: dict[str, int] = {}
        codes = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, n)
        repeat = repeated_words(codes) if len(table) < n else 0
    else:
        repeat = 0
    upper = sum(1 for c in text if c.isupper()) if not text.islower() else 0
    letters = max(1, chars)
    return n, chars, symbols, dup, repeat, symbols / max(n, 1), upper / letters, repeat / max(n, 1), dup / max(lines, 1), text.count("!") / max(n, 1), chars / max(n, 1)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{r} double" for r in RULES)


def measured(docs: DataFrame) -> DataFrame:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame([measures(t) for t in pdf["text"]], columns=[*COUNTS, *RULES])
            yield pd.concat([pdf[["doc_id", "lang"]].reset_index(drop=True), found], axis=1)

    return docs.select(id_of().alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_of().alias("text")).mapInPandas(measure, MEASURED).withColumn("doc_id", id_again())


def binomial_cdf(k: int, n: int, p: float, enough: float = 1.0) -> float:
    """P(X <= k) for X of n trials with chance p; where that exceeds `enough`, some value that does.

    Away from the mean the terms fall fast, so a tail is summed from its largest term on, until the terms no longer count.
    """
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0

    def term(i: int) -> float:
        return math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))

    low = k <= n * p
    i = k if low else k + 1
    here, total = term(i), 0.0
    while here > total * 1e-17 and total <= enough:
        total += here
        if low:
            here, i = here * (1 - p) / p * i / (n - i + 1), i - 1
        else:
            here, i = here * p / (1 - p) * (n - i) / (i + 1), i + 1
    return min(1.0, total) if low else max(0.0, 1.0 - total)


def cutoffs(counts: list[dict], risk: float = 0.05, error: float = 0.05) -> dict[str | None, dict[str, float]]:
    """For each stratum the cutoffs of the strictest step that passes; counts has a row for each stratum: lang, n, and above_<i>, the good documents that step i rejects."""
    level = {row["lang"]: error / len(counts) for row in counts}
    step = dict.fromkeys(level, 0)
    active = {row["lang"]: row for row in counts if row["n"]}
    while True:
        for lang, row in active.items():
            while step[lang] < len(LADDER) and binomial_cdf(int(row[f"above_{step[lang]}"] or 0), int(row["n"]), risk, level[lang]) <= level[lang]:
                step[lang] += 1
        through = [lang for lang in active if step[lang] == len(LADDER)]
        for lang in through:
            del active[lang]
        if not through or not active:
            return {lang: LADDER[i - 1] if i else {} for lang, i in step.items()}
        for lang in active:
            level[lang] += sum(level[x] for x in through) / len(active)


def quality_report(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, broadcast_strata: int = 10_000) -> DataFrame:
    """A row for each document: the counts, base_failed, kept, and the rules that reject it.

    A row of counts for each stratum reaches the driver; up to `broadcast_strata` cutoffs are broadcast, more are joined by a shuffle.
    """
    rows = checkpoint(measured(docs))
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1").select("doc_id")
    rejected = lambda step: reduce(lambda a, b: a | b, [F.col(r) > c for r, c in step.items()])
    above = [F.sum(F.when(rejected(step), 1).otherwise(0)).alias(f"above_{i}") for i, step in enumerate(LADDER)]
    labelled = rows.join(good, "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", *RULES)).alias("m")).select("m.*")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *above).collect()
    chosen = cutoffs([r.asDict() for r in counts], risk, error)
    spark = docs.sparkSession
    table = spark.createDataFrame([(lang, *[c.get(r) for r in RULES]) for lang, c in chosen.items()], "_lang string, " + ", ".join(f"_{r} double" for r in RULES))
    joined = rows.join(F.broadcast(table) if len(counts) <= broadcast_strata else table, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    rejects = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"_{r}"), F.lit(r)) for r in RULES]))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select("doc_id", *COUNTS, base.alias("base_failed"), (~base & (F.size(rejects) == 0)).alias("kept"), F.array_join(rejects, ",").alias("rejected_by"))
