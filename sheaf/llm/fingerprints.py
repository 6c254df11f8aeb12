"""SimHash fingerprints and the block tables that find all fingerprints within a Hamming radius.

Terms are runs of `shingle` words (five by default; a shorter text is one run), weighted by how often
they occur. Each term's 64-bit hashes vote on the bits of the fingerprint: a set bit for, a clear bit
against; a bit is set where the votes for it weigh more than half. Everything here is built-in SQL.

Nulls and empty texts count as the text without words, whose fingerprint is all zeros. Equal texts have
equal fingerprints. Repeated rows and ids keep a row each. A very long text is a row for each of its terms, summed before
anything is shuffled. A bit for which exactly half of the terms vote is clear.
An empty table gives an empty report. Columns besides doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpoint, constant_array, id_of, text_of

LOW = 0x0000000100000001


def term_rows(texts: DataFrame, keys: list[str], text: str = "text", shingle: int = 5) -> DataFrame:
    """keys and _h, a hash of each run of so many words; one row with a null where the text has no word.

    Words stand between spaces, tabs and line ends, in lower case. The runs are the array of words zipped
    with itself, shifted: a run that lacks words at its end is dropped, but for the first.
    """
    plain = F.lower(text_of(text))
    for c in "\n\r\t":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    words = texts.select(*keys, F.filter(F.split(plain, " "), lambda w: w != "").alias("_w0"))
    zipped = F.arrays_zip("_w0", *[F.slice("_w0", i + 1, 2**31 - 1).alias(f"_w{i}") for i in range(1, shingle)])
    runs = words.select(*keys, F.posexplode_outer(zipped).alias("_p", "_s"))
    last = F.col("_s")[f"_w{shingle - 1}" if shingle > 1 else "_w0"]
    return runs.where(last.isNotNull() | (F.coalesce(F.col("_p"), F.lit(0)) == 0)).select(*keys, F.when(F.col("_p").isNotNull(), F.xxhash64("_s.*")).alias("_h"))


def vote_sums(hash_column: str, bits: int) -> list[Column]:
    """Sums that hold two bits' votes each: of bit i in the low half and of bit i + 32 in the high half of a long.

    A half holds 2**31 terms, more than a string has.
    """
    out = []
    for block in range(bits // 64):
        h = F.col(hash_column) if block == 0 else F.when(F.col(hash_column).isNotNull(), F.xxhash64(F.col(hash_column), F.lit(block)))
        out += [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LOW))).alias(f"_v{block}_{i}") for i in range(32)]
    return out


def fingerprint_blocks(bits: int) -> list[Column]:
    """The fingerprint as longs of 64 bits, from vote_sums and the count _terms."""
    out = []
    for block in range(bits // 64):
        word = F.lit(0).cast("long")
        for i in range(32):
            votes = F.col(f"_v{block}_{i}")
            low, high = votes.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(votes, 32)
            for bit, count in ((i, low), (i + 32, high)):
                value = (1 << bit) if bit < 63 else -(1 << 63)
                word = word.bitwiseOR(F.when(count * 2 > F.col("_terms"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return out


def simhash(texts: DataFrame, keys: list[str], text: str = "text", bits: int = 128, shingle: int = 5) -> DataFrame:
    """keys and `fingerprint`, an array of longs. The keys tell the rows of texts apart; only votes are shuffled."""
    votes = term_rows(texts, keys, text, shingle).groupBy(*keys).agg(F.count("_h").alias("_terms"), *vote_sums("_h", bits))
    names = [f"_f{i}" for i in range(bits // 64)]
    blocks = votes.select(*keys, *[F.coalesce(c, F.lit(0).cast("long")).alias(n) for n, c in zip(names, fingerprint_blocks(bits), strict=True)])
    return blocks.select(*keys, F.array(*names).alias("fingerprint"))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def likeness(a: Column, b: Column, bits: int) -> Column:
    """The share of equal bits."""
    return 1.0 - hamming(a, b) / F.lit(float(bits))


def block_masks(bits: int, radius: int, blocks: int) -> list[tuple[int, ...]]:
    """For each choice of `blocks - radius` of so many blocks of bits the masks of the fingerprint's longs, first long first."""
    if not 0 < radius < blocks <= bits:
        raise ValueError("blocks must exceed the radius")
    edges = [bits * i // blocks for i in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        longs = [(mask >> (64 * i)) & ((1 << 64) - 1) for i in range(bits // 64)]
        out.append(tuple(m - (1 << 64) if m >= 1 << 63 else m for m in longs))
    return out


def near_links(fingerprints: DataFrame, radius: int = 3, blocks: int = 4, bits: int = 128, carried: tuple[str, ...] = (), most: int = 1024) -> DataFrame:
    """All pairs (a, b, distance), a < b, of different fingerprints within the radius, with what each carries (a_x, b_x).

    fingerprints: `fingerprint`, an array of longs, once each, and the carried columns. The bits are cut into `blocks`
    blocks. Two fingerprints within the radius agree in `blocks - radius` of them at least, so a table for each choice
    of that many blocks, keyed by their bits, puts every such pair into one bucket. A pair is kept in the first table
    that has it. A bucket with more than `most` fingerprints is dealt to parts, and each two parts meet in a
    task of their own, so no task compares more than `most` with `most`. Equal fingerprints are no pair, and others have
    at most as many partners as there are ways to turn `radius` bits, however large the table is.
    """
    masks = block_masks(bits, radius, blocks)
    n = bits // 64
    keys = [F.array(*[F.col("fingerprint")[i].bitwiseAND(F.lit(m).cast("long")) for i, m in enumerate(mask)]) for mask in masks]
    tables = fingerprints.select("fingerprint", *carried, F.posexplode(F.array(*keys)).alias("_t", "_k"))
    sizes = tables.groupBy("_t", "_k").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").select("_t", "_k", F.ceil(F.col("_size") / most).cast("int").alias("_parts"))
    again = lambda df: df.withColumn("_s", F.xxhash64("_k", "_t"))  # noqa: E731  a key more, so that both sides are dealt anew and a hot bucket can be split
    held = again(tables).join(again(sizes), ["_t", "_k", "_s"]).withColumn("_own", F.pmod(F.xxhash64("fingerprint"), F.col("_parts")).cast("int"))
    side = lambda name, lo, hi: held.select("_t", "_k", lo.alias("_lo"), hi.alias("_hi"), F.col("fingerprint").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in carried])
    left = side("a", F.col("_own"), F.explode(F.sequence(F.col("_own"), F.col("_parts") - 1)))
    right = side("b", F.explode(F.sequence(F.lit(0), F.col("_own"))), F.col("_own"))
    met = left.join(right, ["_t", "_k", "_lo", "_hi"]).where((F.col("_lo") < F.col("_hi")) | (F.col("a") < F.col("b")))
    differs = [F.col("a")[i].bitwiseXOR(F.col("b")[i]) for i in range(n)]
    distance = reduce(lambda x, y: x + y, [F.bit_count(d) for d in differs])
    first = F.lit(len(masks))
    for t, mask in reversed(list(enumerate(masks))):
        first = F.when(reduce(lambda x, y: x & y, [d.bitwiseAND(F.lit(m).cast("long")) == 0 for d, m in zip(differs, mask, strict=True)]), F.lit(t)).otherwise(first)
    near = met.where((distance <= radius) & (first == F.col("_t"))).withColumn("distance", distance)
    swap = F.col("a") > F.col("b")  # across parts either may be the smaller one
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    both = [c for name in carried for c in (pick(f"a_{name}", f"b_{name}").alias(f"a_{name}"), pick(f"b_{name}", f"a_{name}").alias(f"b_{name}"))]
    return near.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), "distance", *both)


def from_hex(fingerprint: Column, bits: int) -> Column:
    """as_hex undone; a string of another length is an error, null stays null."""
    longs = [F.shiftleft(F.conv(F.substring(fingerprint, 16 * i + 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(fingerprint, 16 * i + 9, 8), 16, 10).cast("long")) for i in range(bits // 64)]
    wrong = F.raise_error(F.concat(F.lit(f"not a fingerprint of {bits} bits: "), fingerprint)).cast("array<bigint>")
    return F.when(fingerprint.isNull(), None).when(F.length(fingerprint) != bits // 4, wrong).otherwise(F.array(*longs))


def near_pairs(fingerprints: DataFrame, radius: int = 3, blocks: int = 6, bits: int = 64) -> DataFrame:
    """near_links of hexadecimal strings of `bits` bits, which may repeat: all pairs (a, b, distance), a < b. Null fingerprints have none."""
    once = fingerprints.select("fingerprint").where("fingerprint is not null").distinct()
    found = near_links(once.select(from_hex(F.col("fingerprint"), bits).alias("fingerprint"), F.col("fingerprint").alias("h")), radius, blocks, bits, ("h",))
    return found.select(F.least("a_h", "b_h").alias("a"), F.greatest("a_h", "b_h").alias("b"), "distance")


def ranges_of(docs: DataFrame, rows: int = 1000, most: int = 16_384) -> tuple[list[int], list[int]]:
    """Where ranges of about so many rows begin, by _o (the id) and _th (a hash of the text).

    There are `most` ranges at most, so a range grows where the table has more than `most` times `rows` rows; about eight
    pairs of longs a range reach the driver.
    """
    n = docs.count()
    parts = min(most, max(1, n // rows))
    if parts == 1:
        return [], []
    every = max(1, n // (8 * parts))
    seen = docs.select("_o", "_th").where(F.pmod(F.xxhash64("_o", "_th", F.lit(5)), F.lit(every)) == 0).distinct().collect()
    pairs = sorted((r["_o"], r["_th"]) for r in seen)
    cuts = [pairs[len(pairs) * i // parts] for i in range(1, parts)] if len(pairs) > parts else pairs
    cuts = sorted(set(cuts))
    return [o for o, _ in cuts], [t for _, t in cuts]


def range_number(ids: list[int], hashes: list[int], step: int = 128) -> Column:
    """How many of the (sorted) starts a row does not precede: first among every `step`-th one, then among those after it."""
    if not ids:
        return F.lit(0)
    zipped = lambda i, t: F.arrays_zip(constant_array(i, "bigint").alias("i"), constant_array(t, "bigint").alias("t"))
    reached = lambda x: (x["i"] < F.col("_o")) | ((x["i"] == F.col("_o")) & (x["t"] <= F.col("_th")))
    if len(ids) <= step:
        return F.size(F.filter(zipped(ids, hashes), reached))
    coarse = F.size(F.filter(zipped(ids[step - 1 :: step], hashes[step - 1 :: step]), reached)) * step
    return coarse + F.size(F.filter(F.slice(zipped(ids, hashes), coarse + 1, F.lit(step)), reached))


def with_next(docs: DataFrame, columns: list[str], rows: int = 1000, most: int = 16_384) -> DataFrame:
    """Adds next_<column>: the values of the row that follows by doc_id (nulls first), after the last one the first's.

    Rows are dealt by ranges of ids and, within an id, of _th, a hash of the text: null or repeated ids are many ranges. The
    first row of each range is also sent to the range before it, as a sentinel, so every range finds the successors of
    its rows alone. Equal ids follow one another by _th. Adds _part and _rn, which tell all rows apart, and _sentinel
    (0 for real rows); callers drop the sentinels when they no longer need them.
    """
    keyed = docs.withColumns({"_o": id_of(), "_th": F.xxhash64(text_of())})
    dealt = keyed.withColumn("_part", range_number(*ranges_of(keyed, rows, most)).cast("int"))
    firsts = dealt.groupBy("_part").agg(F.min(F.struct("_o", "_th")).alias("_first"))
    found = sorted((r["_part"], r["_first"]["_o"], r["_first"]["_th"]) for r in firsts.collect())  # a row for each range
    found = found or [(0, 0, 0)]  # an empty table
    first_of_all = found[0][0]
    size = found[-1][0] + 1
    ids, hashes, before_by_part = [0] * size, [0] * size, [0] * size
    for i, (p, o, t) in enumerate(found):
        ids[p], hashes[p], before_by_part[p] = o, t, found[i - 1][0]
    of_part = lambda values, kind: F.get(constant_array(values, kind), F.col("_part"))
    leads = (F.col("_o") == of_part(ids, "bigint")) & (F.col("_th") == of_part(hashes, "bigint"))
    copies = F.when(
        leads,
        F.array(
            F.struct(F.col("_part").alias("p"), F.lit(0).alias("s")),
            F.struct(of_part(before_by_part, "int").alias("p"), F.when(F.col("_part") == first_of_all, 2).otherwise(1).alias("s")),
        ),
    ).otherwise(F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("s"))))
    spread = dealt.withColumn("_copy", F.explode(copies)).withColumns({"_part": F.col("_copy.p"), "_sentinel": F.col("_copy.s")}).drop("_copy")
    order = W.partitionBy("_part").orderBy("_sentinel", "_o", "_th")
    return spread.withColumns({"_rn": F.row_number().over(order)} | {f"next_{c}": F.lead(c).over(order) for c in columns})


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints_of(docs: DataFrame, bits: int = 128, shingle: int = 5, rows: int = 1000) -> DataFrame:
    """A row for each document: its fingerprint (array of longs), its edited text's, and the likeness to that and to the next document."""
    rows = with_next(docs.select("doc_id", text_of().alias("text")), ["text"], rows).withColumn("next_text", text_of("next_text"))
    keys = ["_part", "_rn", "_sentinel", "doc_id", "n_chars", "edited_sha256", "_kind"]
    edited = edited_text(F.col("text"), F.col("next_text"))
    pairs = (
        rows.withColumn("_edited", F.when(F.col("_sentinel") == 0, edited))
        .withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.col("_edited").cast("binary"), 256)})
        .withColumn("_t", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("_edited").alias("t")))))
        .where("_sentinel = 0 or _t.k = 0")
        .select(*keys[:-1], F.col("_t.k").alias("_kind"), F.col("_t.t").alias("text"))
    )
    prints = simhash(pairs, keys, "text", bits, shingle)
    docs_again = prints.groupBy("_part", "_rn").agg(
        *[F.first(c).alias(c) for c in ("_sentinel", "doc_id")],
        F.max("n_chars").alias("n_chars"),
        F.max("edited_sha256").alias("edited_sha256"),
        F.max(F.when(F.col("_kind") == 0, F.col("fingerprint"))).alias("_f"),
        F.max(F.when(F.col("_kind") == 1, F.col("fingerprint"))).alias("_g"),
    )
    following = F.lead("_f").over(W.partitionBy("_part").orderBy("_rn"))
    return (
        docs_again.withColumn("_n", following)
        .where("_sentinel = 0")
        .select("doc_id", "n_chars", "edited_sha256", F.col("_f").alias("fingerprint"), F.col("_g").alias("edited"), likeness(F.col("_f"), F.col("_g"), bits).alias("near_edited"), likeness(F.col("_f"), F.col("_n"), bits).alias("near_next"))
    )


def fingerprint_report(docs: DataFrame, bits: int = 128, shingle: int = 5, radius: int = 3, rows: int = 1000) -> DataFrame:
    """fingerprints_of as hexadecimal strings, with near_docs (how many other documents have a fingerprint within the radius) and first_near (their and its own smallest doc_id).

    The block tables hold each different fingerprint once. What a document finds is joined to it by its fingerprint.
    """
    made = checkpoint(fingerprints_of(docs, bits, shingle, rows))
    once = checkpoint(made.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("id")))
    links = near_links(once, radius, radius + 1, bits, ("n", "id"))
    ends = links.select(F.col("a").alias("fingerprint"), F.col("b_n").alias("n"), F.col("b_id").alias("id")).union(links.select("b", "a_n", "a_id"))
    partners = ends.groupBy("fingerprint").agg(F.sum("n").alias("_n"), F.min("id").alias("_id"))
    found = once.join(partners, "fingerprint", "left").select("fingerprint", (F.col("n") - 1 + F.coalesce("_n", F.lit(0))).alias("near_docs"), F.least("id", "_id").alias("first_near"))
    again = lambda df: df.withColumn("_s", F.xxhash64("fingerprint"))  # noqa: E731  both sides are dealt anew, so a frequent fingerprint can be split
    return again(made).join(again(found), ["fingerprint", "_s"]).select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fingerprint")).alias("fingerprint"), as_hex(F.col("edited")).alias("edited_fingerprint"), "near_edited", "near_next", "near_docs", "first_near"
    )
