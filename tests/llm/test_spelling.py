"""Spelling variants against a comparison of all pairs of words, and on nulls, odd rows, long words and empty tables."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import spelling as sp
from sheaf.llm.queries import QUERIES
from tests.llm.test_operators import SCHEMA, odd_rows


def near(a, b):
    """Whether one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def counted(rows):
    out = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def all_pairs(words, times=10):
    """word: (form, root, n, n_near, form_n), comparing words by their first or second half, one of which near words share or nearly."""
    beside = collections.defaultdict(set)
    for w in words:
        half = len(w) // 2
        for cut in (half - 1, half, half + 1):
            beside["front", w[:cut]].add(w)
            beside["back", w[cut:]].add(w)
    out, form = {}, {}
    for w, n in words.items():
        half = len(w) // 2
        some = {v for cut in (half - 1, half, half + 1) for key in (("front", w[:cut]), ("back", w[cut:])) for v in beside[key]}
        mine = {v for v in some if near(w, v)}
        best = min(mine, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
        out[w] = len(mine)
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, out[w], words.get(form[w]))
    return out


def rows_of(df):
    found = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}
    assert len(out) == len(found)
    return out


def test_whole_table(spark, sf):
    words = counted([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    found = rows_of(QUERIES["op12_spelling"](spark, sf))
    assert found == all_pairs(words) and sum(v[0] is not None for v in found.values()) >= 5


def test_pairs_find_all_near_words(spark):
    """Words of few letters, so that runs of equal ones, ties and chains of forms are many; by a comparison of all pairs."""
    rng = np.random.default_rng(9)
    words = {"".join("abÿ"[i] for i in rng.integers(0, 3, rng.integers(4, 9))): int(10 ** rng.integers(0, 4)) for _ in range(700)}
    found = rows_of(sp.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)))
    for w, n in words.items():
        mine = {v for v in words if near(w, v)}
        best = min(mine, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        assert (found[w][0], found[w][2], found[w][3], found[w][4]) == (form, n, len(mine), words.get(form))
        assert found[w][1] == (found[form][1] if form else w)
    assert any(v[0] is not None and v[1] != v[0] for v in found.values())


@pytest.mark.parametrize("parts", [1, 7])
def test_trie_nodes_are_numbered_alike_over_all_partitions(spark, parts):
    rng = np.random.default_rng(10)
    words = sorted({"".join("abc"[i] for i in rng.integers(0, 3, rng.integers(1, 9))) for _ in range(400)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = sp.numbered(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), F.col("word"), "path").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    node = {}
    for r in rows:
        assert len(r["path"]) == len(r["word"])
        for k, x in enumerate(r["path"]):
            assert node.setdefault(r["word"][: k + 1], x) == x
    assert len(set(node.values())) == len(node) and 0 not in node.values()
    last = [r["path"][-1] for r in sorted(rows, key=lambda r: r["word"])]
    assert last == sorted(last)


def test_a_word_with_very_many_letters_and_many_neighbours(spark):
    long = "q" * 3000
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    words = {long: 5, long + "q": 60, "z" + long: 5, "centrum": 1000} | {f"centr{x}m": 1 for x in letters if x != "u"}
    found = rows_of(sp.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert found[long] == (long + "q", long + "q", 5, 2, 60) and found["z" + long][3:] == (2, 60) and found[long + "q"] == (None, long + "q", 60, 2, None)
    assert found["centrum"] == (None, "centrum", 1000, len(letters) - 1, None) and found["centram"] == ("centrum", "centrum", 1, len(letters) - 1, 1000)


def test_odd_rows(spark):
    rows = odd_rows()
    found = rows_of(sp.variant_report(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert found == all_pairs(counted([(r[0], r[1]) for r in rows]))
    assert sp.variant_report(spark.createDataFrame([], SCHEMA)).count() == 0
