"""Spelling variants: words one code point apart, found by integer pairs of trie nodes.

Every word of the vocabulary lies on a path of the trie of all words, and reversed on one of the trie of all reversed
words. Their nodes are numbered, so a place in a word is two integers: the node of what stands before it and the node of
what stands behind. Two words that differ in one replaced code point share the pair around it, and a word with one
code point more has, around that, the pair which the shorter word has where it is inserted. A join by equal pairs
therefore finds exactly the near words, without comparing strings.

Numbering: the words are dealt to ranges and sorted; a task walks down its range and counts a node for each code point
that the word before does not share. What the first word of a range shares with the last of the range before, it takes from there:
of each range the first and last word, so two rows a partition, pass through the driver for that.

Scale: a word gives two rows a code point, however long it is. Around one pair stand at most one shorter word and one word for
each code point of the alphabet, so no group grows with the input. No pairs are made: a group tells each of its words
how many are near it there and which is the most frequent. A word with many neighbours is summed up in parts.

Null and empty texts have no words; a null doc_id counts as empty in the key. Repeated rows count as often as they stand. Very
long texts are cut in their row. An empty table gives an empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import written
from .common import text_of

#: Runs of these are words; only A-Z are made small.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a node's number below its partition's.
NODE_BITS = 40
GAP, FIRST_OF_RUN, INSIDE_RUN = range(3)


def runs(docs: DataFrame, min_length: int = 7) -> DataFrame:
    """doc_id, run: the maximal runs of letters that have min_length of them, A-Z lower-cased."""
    found = F.regexp_extract_all(text_of(), F.lit(LETTERS), F.lit(0))
    long = F.filter(found, lambda w: F.length(w) >= min_length)
    return docs.select("doc_id", F.explode(long).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def misspelt(words: DataFrame, every: int = 31) -> DataFrame:
    """word: the runs; where `every` divides the crc32 of `doc_id:run`, a code point is left out, its place by the crc32 too."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (F.col("_h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return words.withColumn("_h", h).select(F.when(F.col("_h") % every == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """word, n: the words that are long and frequent enough."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def shared(a: str, b: str) -> int:
    """How many code points both begin with."""
    for i, (x, y) in enumerate(zip(a, b)):  # noqa: B905
        if x != y:
            return i
    return min(len(a), len(b))


def numbered(words: DataFrame, key: Column, name: str) -> DataFrame:
    """words (distinct by key) with `name`: the numbers of the key's trie nodes, from its first code point to its last.

    Equal beginnings have equal numbers, others different ones, all above 0. The last number stands for the whole key
    and grows with the key's code points.
    """
    kinds = words.drop("_key").schema
    columns, arrays = kinds.fieldNames(), [f.name for f in kinds if f.dataType.typeName() == "array"]

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, path, count, before, first = TaskContext.get().partitionId(), [], 0, "", True
        held: pd.DataFrame | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            if held is not None:
                yield held
            paths = []
            for word in pdf["_key"]:
                same = shared(before, word)
                new = len(word) - same
                path = path[:same] + list(range(count + 1, count + 1 + new))
                count, before = count + new, word
                paths.append(path)
            held = pdf.assign(_path=paths, _part=part, _edge=False)
            held.iloc[0, held.columns.get_loc("_edge")] |= first
            first = False
        if held is not None:
            held.iloc[-1, held.columns.get_loc("_edge")] = True
            yield held

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "_key string, _path array<long>, _part int, _edge boolean"])
    local = written(words.withColumn("_key", key).repartitionByRange("_key").sortWithinPartitions("_key").mapInPandas(walked, kind), name)
    ends = sorted((r["_part"], r["_key"], r["_path"]) for r in local.where("_edge").select("_part", "_key", "_path").collect())
    carried: dict[int, list[int]] = {}
    last_key, last_path = "", []
    for part, word, path in ends:
        if part not in carried:
            carried[part] = last_path[: shared(last_key, word)]
        mine = carried[part]
        last_key, last_path = word, [mine[c - 1] if c <= len(mine) else (part << NODE_BITS) + c for c in path]
    taken = words.sparkSession.createDataFrame([(p, c) for p, c in carried.items()], "_part int, _taken array<long>")
    joined = local.join(F.broadcast(taken), "_part")  # a row a partition
    number = F.transform("_path", lambda c: F.when(c <= F.size("_taken"), F.get("_taken", (c - 1).cast("int"))).otherwise(F.shiftleft(F.col("_part").cast("long"), NODE_BITS) + c))
    assert set(arrays) <= set(columns)
    return joined.select(*columns, number.alias(name))


def places(words: DataFrame) -> DataFrame:
    """p, s, kind, n, id: of each word the pairs around its code points, and around its gaps. words: word, n, forward, backward.

    Leaving out one or another of equal code points side by side gives one word, so only the first of them meets gaps.
    """
    length = F.size("forward")
    rows = words.select("n", F.get("forward", length - 1).alias("id"), F.split("word", "").alias("_c"), F.concat(F.array(F.lit(0).cast("long")), "forward").alias("_f"), F.concat(F.array(F.lit(0).cast("long")), "backward").alias("_b"))
    size = F.size("_f")
    around = lambda i, kind, left: F.struct(F.get("_f", i).alias("p"), F.get("_b", size - left - i).alias("s"), kind.alias("kind"))
    again = lambda i: F.coalesce(F.get("_c", i - 1) == F.get("_c", i), F.lit(False))
    skipped = F.transform(F.sequence(F.lit(0), size - 2), lambda i: around(i, F.when((i > 0) & again(i), INSIDE_RUN).otherwise(FIRST_OF_RUN), 2))
    gaps = F.transform(F.sequence(F.lit(0), size - 1), lambda i: around(i, F.lit(GAP), 1))
    return rows.select("n", "id", F.explode(F.concat(skipped, gaps)).alias("_x")).select("_x.*", "n", "id")


def nearest(rows: DataFrame) -> DataFrame:
    """id, n_near, best (n, -id): how many words are near each word that has any, and the most frequent of these, the smallest if several."""
    met = rows.withColumn("_m", F.count(F.lit(1)).over(W.partitionBy("p", "s"))).where(F.col("_m") > 1)
    groups = met.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct("n", (-F.col("id")).alias("minus"), "kind")), asc=False).alias("_g"))
    who = lambda x: F.struct(x["n"].alias("n"), x["minus"].alias("minus"))
    groups = groups.select(F.filter("_g", lambda x: x["kind"] != GAP).alias("_skips"), F.filter("_g", lambda x: x["kind"] == GAP).alias("_gaps"), F.filter("_g", lambda x: x["kind"] == FIRST_OF_RUN).alias("_ends"))
    gap, first, second, none = F.get("_gaps", F.lit(0)), F.get("_skips", F.lit(0)), F.get("_skips", F.lit(1)), F.lit(None).cast("struct<n:bigint,minus:bigint>")
    told = lambda x, near, best: F.struct((-x["minus"]).alias("id"), near.cast("long").alias("near"), best.alias("best"))
    other = lambda x: F.when(x["minus"] != first["minus"], who(first)).when(F.size("_skips") > 1, who(second)).otherwise(none)
    meets = lambda x: (F.size("_gaps") > 0) & (x["kind"] == FIRST_OF_RUN)
    skips = F.transform("_skips", lambda x: told(x, F.size("_skips") - 1 + meets(x).cast("int"), F.greatest(other(x), F.when(meets(x), who(gap)).otherwise(none))))
    gaps = F.transform("_gaps", lambda x: told(x, F.size("_ends"), F.when(F.size("_ends") > 0, who(F.get("_ends", F.lit(0)))).otherwise(none)))
    each = groups.select(F.explode(F.concat(skips, gaps)).alias("_x")).select("_x.*").where("near > 0")
    return each.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root for each (id, form): where the forms end. A form is more frequent than its word, so there are no rings.

    Each round doubles the reach, so the longest chain takes a few; each round is written.
    """
    reached = forms.select("id", F.col("form").alias("root"), F.lit(True).alias("_moved"))
    while True:
        reached = written(reached, "roots")
        if not reached.where("_moved").limit(1).count():
            return reached.drop("_moved")
        further = reached.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        reached = reached.drop("_moved").join(further, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))


def variants(vocabulary: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word of (word, n), and the near word at least `times` as frequent that it is a variant of."""
    both = written(numbered(numbered(vocabulary.select("word", F.col("n").cast("long").alias("n")), F.col("word"), "forward"), F.reverse("word"), "backward"), "nodes")
    words = both.select("word", "n", F.get("forward", F.size("forward") - 1).alias("id"))
    near = words.join(nearest(places(both)), "id", "left")
    judged = written(near.select("*", F.when(F.col("best.n") >= times * F.col("n"), -F.col("best.minus")).alias("form")), "variants")
    ends = roots(judged.where("form is not null").select("id", "form"))
    spelt = lambda name: words.select(F.col("id").alias(name), F.col("word").alias(f"_{name}"))
    out = judged.join(ends, "id", "left").join(spelt("form"), "form", "left").join(spelt("root"), "root", "left")
    return out.select("word", F.col("_form").alias("form"), F.coalesce("_root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best.n")).alias("form_n"))


def variant_report(docs: DataFrame) -> DataFrame:
    """The variants among the words of all texts, some of them misspelt on purpose."""
    return variants(vocabulary(misspelt(runs(docs))))
