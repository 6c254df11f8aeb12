"""Sections, windows and element groups. A document's text stays in its row until it is cut, so nothing is shuffled."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.lexicon import HEADER_LATIN
from ..functions.text import let, strip


def section_array(content: Column, header: str = HEADER_LATIN) -> Column:
    """The sections of a text: a header line starts one if a line that is not blank stands before it. Without two sections the text as it is."""

    def parts(ls: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(ls)))
        return F.when(F.size(starts) > 1, F.zip_with(starts, ends, lambda a, b: strip(F.array_join(F.slice(ls, a + 1, b - a), "\n"))))

    def starts(stripped: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(stripped) - 1)
        first = F.array_position(F.transform(stripped, lambda x: x != ""), True) - 1
        return let(first, lambda said: F.concat(F.array(F.lit(0)), F.filter(at, lambda i: (said >= 0) & (i > said) & F.get(stripped, i).rlike(header))))

    cut = let(F.split(content, "\n"), lambda ls: let(let(F.transform(ls, strip), starts), lambda s: parts(ls, s)))
    return F.coalesce(cut, F.array(content))


def window_array(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Windows of the text, without blank ones, stripped."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.filter(F.transform(starts, lambda i: strip(F.substring(text, i + 1, F.lit(size)))), lambda w: w != "")


def sections(corpus: DataFrame, header: str = HEADER_LATIN) -> DataFrame:
    return corpus.select("document_id", F.posexplode(section_array(F.col("content"), header)).alias("section_index", "section"))


def windows(corpus: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    return corpus.select("document_id", F.posexplode(window_array(F.col("content"), size, overlap)).alias("chunk_index", "content"))


def chunk_id(document: str, *parts: str) -> Column:
    return F.md5(F.concat_ws("_", document, *parts))


def smart_chunks(corpus: DataFrame, header: str = HEADER_LATIN, size: int = 1000, overlap: int = 200) -> DataFrame:
    """document_id, section_index, chunk_index (within the section), chunk_id, content."""
    cut = sections(corpus, header).select("document_id", "section_index", F.posexplode(window_array(F.col("section"), size, overlap)).alias("chunk_index", "content"))
    return cut.withColumn("chunk_id", chunk_id("document_id", "section_index", "chunk_index"))


def short_or_smart(corpus: DataFrame, short: int = 500, **options) -> DataFrame:
    """A short document is one chunk; the others are cut by smart_chunks."""
    one = corpus.where(F.length("content") <= short).select("document_id", F.lit(0).alias("section_index"), F.lit(0).alias("chunk_index"), strip(F.col("content")).alias("content")).where("content <> ''")
    one = one.withColumn("chunk_id", chunk_id("document_id", "section_index", "chunk_index"))
    return one.unionByName(smart_chunks(corpus.where(F.length("content") > short), **options))


def element_groups(elements: DataFrame) -> DataFrame:
    """Adds group_id: each title opens a group."""
    run = W.partitionBy("document_id").orderBy("elem_idx").rowsBetween(W.unboundedPreceding, 0)
    return elements.withColumn("group_id", F.sum(F.when(F.col("element_type") == "title", 1).otherwise(0)).over(run))


def semantic_level(text: Column) -> Column:
    """The depth of a dotted number that the text begins with; 2 for a Hangul letter with a dot and a blank; else 1."""
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", F.size(F.split(number, r"\."))).when(text.rlike(r"^[가-힣]\. "), 2).otherwise(1)


def group_summary(elements: DataFrame, domain_words: list[str]) -> DataFrame:
    """A row for each group of elements: type, title, level, parent, content, and its figures."""
    grouped = element_groups(elements)
    kind = F.col("element_type")
    per = grouped.groupBy("document_id", "group_id").agg(
        F.count(F.lit(1)).alias("n_elements"), F.count_if(kind == "title").alias("_titles"), F.count_if(kind == "table").alias("_tables"), F.count_if(kind == "list").alias("_lists"),
        F.count_distinct("element_type").alias("_kinds"), F.avg("font_size").alias("mean_font"), F.bool_or(F.col("font_weight") == "bold").alias("has_bold"),
        F.array_sort(F.collect_set("page_number")).alias("pages"),
        F.sum(F.when(kind == "title", 0.3).when(kind == "subtitle", 0.2).when(F.col("font_weight") == "bold", 0.1).otherwise(0.0)).alias("_weight"),
        F.min(F.when(kind == "title", F.struct("elem_idx", "text_content"))).alias("_title"),
        F.sort_array(F.collect_list(F.struct("elem_idx", "text_content"))).alias("_texts"),
    )
    content = F.array_join(F.transform("_texts", lambda x: x["text_content"]), "\n")
    kinds = F.when((F.col("_titles") > 0) & (F.col("n_elements") == 1), "title").when(F.col("_tables") > 0, "table").when(F.col("_lists") == F.col("n_elements"), "list").when(F.col("_kinds") > 2, "mixed").otherwise("content")
    rows = per.select(
        "document_id", "group_id", "n_elements", kinds.alias("chunk_type"), F.coalesce("_title.text_content", F.lit("")).alias("title"), content.alias("content"),
        "mean_font", "has_bold", F.array_join("pages", ",").alias("pages"), "_weight",
    )
    rows = rows.withColumn("level", F.when(F.col("title") != "", semantic_level(F.col("title"))).otherwise(1))
    hits = sum((F.when(F.contains(F.col("content"), F.lit(w)), 0.05).otherwise(0.0) for w in domain_words), F.lit(0.0))
    score = F.least(F.lit(0.5) + F.col("_weight") + F.when(F.length("content") > 500, 0.1).otherwise(0.0) + hits, F.lit(1.0))
    before = W.partitionBy("document_id").orderBy("group_id")
    return rows.withColumns({
        "importance": score, "parent_section": F.coalesce(F.lag("title").over(before), F.lit("")), "parent_level": F.coalesce(F.lag("level").over(before), F.lit(1)),
    }).drop("_weight")


def keywords(rows: DataFrame, key: str = "document_id", text: str = "content", top: int = 10) -> DataFrame:
    """The most frequent words (two Hangul syllables or three ASCII letters at least); the earlier word among equals, Hangul before Latin.

    Words are counted in the row of a key's texts, so the texts are shuffled and their words are not.
    """
    @F.pandas_udf("string")
    def most(batch: pd.Series) -> pd.Series:
        return batch.map(lambda texts: most_frequent(texts, top))

    texts = rows.groupBy(key).agg(F.collect_list(text).alias("_t"))
    return texts.select(key, most("_t").alias("keywords")).where("keywords <> ''")


HANGUL, LATIN = re.compile("[가-힣]{2,}"), re.compile("[A-Za-z]{3,}")


def most_frequent(texts: Iterable[str], top: int) -> str:
    n: Counter[str] = Counter()
    first: dict[str, int] = {}
    for text in texts:
        words = HANGUL.findall(text) + LATIN.findall(text)
        n.update(words)
        for pos in range(len(words) - 1, -1, -1):
            first[words[pos]] = min(pos, first.get(words[pos], pos))
    return ",".join(sorted(n, key=lambda w: (-n[w], first[w], w))[:top])


def merge_short(chunks: DataFrame, key: str = "document_id", order: str = "seq", least: int = 50) -> DataFrame:
    """A chunk shorter than `least`, white space at its ends aside, joins the one before it."""
    run = W.partitionBy(key).orderBy(order)
    opens = F.when((F.length(strip(F.col("content"))) >= least) | (F.row_number().over(run) == 1), 1).otherwise(0)
    marked = chunks.withColumn("_open", opens).withColumn("merged_id", F.sum("_open").over(run.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(key, "merged_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "content"))), lambda x: x["content"]), "\n").alias("content"), F.count(F.lit(1)).alias("n_merged"))


#: Lines that a chunk may be cut before, without white space at their ends.
STRONG = r"^\d+\.\s+[가-힣A-Za-z]+|^제\s*\d+\s*장|^[가-힣]+\s*사업\s*개요|^[가-힣]+\s*기술\s*요구사항"
MEDIUM = r"^\s*\([가-힣]\)|^\s*[가-힣]\.|^\s*\d+\)"


def pack_lines(text: Column, size: int = 1000, boundary: str = f"(?:{STRONG})|(?:{MEDIUM})") -> Column:
    """Start positions of pieces: once a line would pass the size, the piece ends before it if it is a boundary."""
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("now"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, line: Column) -> Column:
        n = F.length(line) + 1
        cut = (s["now"] + n > size) & strip(line).rlike(boundary)
        return F.struct((s["pos"] + n).alias("pos"), F.when(cut, n).otherwise(s["now"] + n).alias("now"), F.when(cut, F.concat(s["cuts"], F.array(s["pos"]))).otherwise(s["cuts"]).alias("cuts"))

    return F.aggregate(F.split(text, "\n"), start, step)["cuts"]


def pack_sentences(text: Column, size: int = 1000) -> Column:
    """Start positions of pieces cut at sentence ends; the ends themselves are not counted."""
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("now"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, sentence: Column) -> Column:
        n = F.length(sentence)
        cut = s["now"] + n > size
        return F.struct((s["pos"] + n).alias("pos"), F.when(cut, n).otherwise(s["now"] + n).alias("now"), F.when(cut, F.concat(s["cuts"], F.array(s["pos"]))).otherwise(s["cuts"]).alias("cuts"))

    return F.aggregate(F.split(text, r"[.!?]\s+"), start, step)["cuts"]


def sub_chunks(text: Column, cuts: Column, overlap: int = 200, least: int = 50) -> Column:
    """Pieces up to each cut and the end, stripped, after the `overlap` characters before them if there is a piece already.

    A short piece joins the piece before on a line of its own. The next one then begins where the short one did, so
    its text stands in both; without a piece before, only there.
    """
    ends = F.concat(cuts, F.array(F.length(text)))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, end: Column) -> Column:
        piece = strip(F.substring(text, s["at"] + 1, end - s["at"]))
        out, some = s["out"], F.size(s["out"]) > 0
        early = F.greatest(s["at"] - overlap, F.lit(0))
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat(F.element_at(out, -1), F.lit("\n"), piece)))
        longer = F.concat(out, F.array(F.concat(F.when(some, F.substring(text, early + 1, s["at"] - early)).otherwise(F.lit("")), piece)))
        short = F.length(piece) < least
        return F.struct(F.when(short, s["at"]).otherwise(end).alias("at"), F.when(short & some, joined).when(short, out).otherwise(longer).alias("out"))

    return F.aggregate(ends, empty, step)["out"]


def emergency_split(text: Column, size: int = 1000) -> Column:
    """Sentences packed greedily, each after a blank, until the next one would pass the size; the blanks count, also that before the first."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, sentence: Column) -> Column:
        full = (F.length(s["now"]) + F.length(sentence) > size) & (s["now"] != "")
        return F.struct(F.when(full, sentence).otherwise(F.concat(s["now"], F.lit(" "), sentence)).alias("now"), F.when(full, F.concat(s["out"], F.array(strip(s["now"])))).otherwise(s["out"]).alias("out"))

    end = lambda s: F.when(strip(s["now"]) != "", F.concat(s["out"], F.array(strip(s["now"])))).otherwise(s["out"])
    return F.aggregate(F.split(text, r"(?<=[.!?])\s+"), start, step, end)


def text_importance(text: Column, domain_words: list[str]) -> Column:
    """The importance of a text of which nothing else is known: half, more if it is long and for each of the words in it, 1 at most."""
    held = reduce(lambda x, y: x + y, [F.contains(text, F.lit(w)).cast("int") for w in domain_words], F.lit(0))
    return F.least(F.lit(1.0), 0.5 + F.when(F.length(text) > 500, 0.1).otherwise(0.0) + held * 0.05)


def enhanced_chunks(elements: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Groups of elements up to the size are one chunk each, as they are; longer ones several."""
    groups = element_groups(elements).groupBy("document_id", "group_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("elem_idx", "text_content"))), lambda x: x["text_content"]), "\n").alias("content"))
    cuts = let(pack_lines(F.col("content"), size), lambda c: F.when(F.size(c) == 0, pack_sentences(F.col("content"), size)).otherwise(c))
    pieces = F.when(F.length("content") <= size, F.array("content")).otherwise(let(cuts, lambda c: sub_chunks(F.col("content"), c, overlap)))
    return groups.select("document_id", "group_id", F.posexplode(pieces).alias("part", "content"))
