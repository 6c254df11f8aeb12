"""Small rows with results worked out by hand: Korean rules, folds over lines, ingest, and invariants."""

import pytest
from pyspark.sql import functions as F

from sheaf.functions import lexicon as L
from sheaf.functions import text as T
from sheaf.operators import analytics, bm25, chunking, enhance, fusion, ingest, layout, metadata, vectors


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_agency(spark):
    df = spark.createDataFrame([("발주기관: 국민연금공단\n다음", "한국공사_사업.hwp"), ("x", "2024_x.hwp"), ("주관 한국수자원공사 끝", "a.hwp"), (None, None)], "t string, n string")
    found = df.select(metadata.agency(F.col("t")), metadata.agency_of_name(F.col("n"))).collect()
    assert [tuple(r) for r in found] == [("국민연금공단", "한국공사"), (None, None), ("한국수자원공사", None), (None, None)]


def test_business_type_ties_and_default(spark):
    df = spark.createDataFrame([("시스템 구축 시스템 구축 홈페이지 구축", "f"), ("홈페이지 구축, 시스템 구축", "f"), ("없음", "f")], "t string, n string")
    assert [r[0] for r in df.select(metadata.business_type(F.col("t"), F.col("n"))).collect()] == ["정보시스템구축", "정보시스템구축", "기타"]


def test_budget(spark):
    df = spark.createDataFrame([("예산: 1,200,000원",), ("총 사업비 500원",), ("5억 원 규모",), ("없음",)], "t string")
    text, amount = metadata.budget(F.col("t"))
    assert [tuple(r) for r in df.select(text, amount).collect()] == [("1200000원", 1200000), (None, None), (None, 500_000_000), (None, None)]


def test_deadline(spark):
    df = spark.createDataFrame([("제출마감: 2024년10월1일",), ("2024.10.1일까지",), ("없음",)], "t string")
    text, date = metadata.deadline(F.col("t"))
    assert [(r[0], str(r[1])) for r in df.select(text, date).collect()] == [("2024-10-1", "2024-10-01"), ("2024-10-01", "2024-10-01"), (None, "None")]


def test_notice_fields_and_merge(spark):
    df = spark.createDataFrame([("사업명: 새 시스템\n발주처 : 시청\n마감일: 2024-01-02",)], "content string")
    r = metadata.notice_fields(df).first()
    assert (r["business_name"], r["agency"], r["deadline"], r["budget"]) == ("새 시스템", "시청", "2024-01-02", None)
    merged = one(spark, "a map<string,string>, b map<string,string>", ({"x": "1", "y": "2"}, {"y": "3"}), metadata.merge(F.col("a"), F.col("b")))[0]
    assert merged == {"x": "1", "y": "3"}


def test_sections(spark):
    df = spark.createDataFrame([("a", "\n1. 사업개요\n내용\n제 2 장\n둘\n[일정]\n셋"), ("b", "머리 없음\n둘"), ("c", "")], "document_id string, content string")
    found = chunking.sections(df, L.HEADER_KO).orderBy("document_id", "section_index").collect()
    assert [(r[0], r[1], r[2]) for r in found] == [("a", 0, "1. 사업개요\n내용"), ("a", 1, "제 2 장\n둘"), ("a", 2, "[일정]\n셋"), ("b", 0, "머리 없음\n둘"), ("c", 0, "")]


def test_windows_overlap_and_blank(spark):
    df = spark.createDataFrame([("a", "abcdefghij"), ("b", "   "), ("c", "")], "document_id string, content string")
    found = [(r[0], r[1], r[2]) for r in chunking.windows(df, 4, 1).collect()]
    assert found == [("a", 0, "abcd"), ("a", 1, "defg"), ("a", 2, "ghij"), ("a", 3, "j")]


def by_hand_cuts(text, size):
    import re

    cuts, pos, now = [], 0, 0
    for line in text.split("\n"):
        n = len(line) + 1
        if now + n > size and re.match(f"(?:{chunking.STRONG})|(?:{chunking.MEDIUM})", line.strip()):
            cuts.append(pos)
            now = 0
        pos += n
        now += n
    return cuts


def test_pack_lines_and_sub_chunks(spark):
    text = "\n".join(f"{i}. title {i}\n" + "word " * 12 for i in range(6))
    df = spark.createDataFrame([(text,)], "t string")
    cuts = df.select(chunking.pack_lines(F.col("t"), 100)).first()[0]
    assert cuts == by_hand_cuts(text, 100) and len(cuts) == 2
    pieces = df.select(chunking.sub_chunks(F.col("t"), F.array(*map(F.lit, cuts)), 10, 5)).first()[0]
    bounds = [0, *cuts, len(text)]
    assert pieces == [text[max(a - 10, 0) : a] + text[a:b].strip() for a, b in zip(bounds, bounds[1:])]


def test_sub_chunks_join_short_pieces(spark):
    df = spark.createDataFrame([("aaaaaaaaaabbbcccccccccc",)], "t string")
    assert df.select(chunking.sub_chunks(F.col("t"), F.array(F.lit(10), F.lit(13)), 2, 5)).first()[0] == ["aaaaaaaaaa\nbbb", "aabbbcccccccccc"]
    assert df.select(chunking.sub_chunks(F.col("t"), F.array(F.lit(3), F.lit(13)), 2, 5)).first()[0] == ["aaaaaaaaaabbb", "bbcccccccccc"]  # nothing before the short one
    assert df.select(chunking.sub_chunks(F.col("t"), F.array(F.lit(20)), 2, 5)).first()[0] == ["aaaaaaaaaabbbccccccc\nccc"]


def test_sentences(spark):
    df = spark.createDataFrame([("One two. Three four! Five? Six",)], "t string")
    assert df.select(chunking.emergency_split(F.col("t"), 20)).first()[0] == ["One two. Three four!", "Five? Six"]
    # positions leave out the separators, as the rule says
    assert df.select(chunking.pack_sentences(F.col("t"), 12)).first()[0] == [7, 17]


def test_semantic_level(spark):
    df = spark.createDataFrame([("1.2.3 x",), ("가. x",), ("x",)], "t string")
    assert [r[0] for r in df.select(chunking.semantic_level(F.col("t"))).collect()] == [3, 2, 1]


def test_clean(spark):
    text = "a\x00b  c\t\t d\n\n\n\ne------------f----------g\r" + "\n" * 12 + "\n"
    assert one(spark, "t string", (text,), T.clean(F.col("t")))[0] == "ab c\t\t d\n\ne-f----------g"
    assert one(spark, "t string", ("x\r" + "\r" * 12 + "y",), T.clean(F.col("t")))[0] == "x\ry"


def test_fallback_and_error_content(spark):
    long = "x" * 120
    df = spark.createDataFrame([("", long, "f"), (long + "y", long, "f"), ("", "", "f")], "a string, b string, n string")
    text, method = T.first_meaningful([("a", F.col("a")), ("b", F.col("b"))], F.concat(F.lit("file: "), "n"))
    assert [tuple(r) for r in df.select(text, method).collect()] == [(long, "b"), (long + "y", "a"), ("file: f", "filename_only")]
    body, error = ingest.error_content(F.col("a"), F.col("n"), F.lit("broken"))
    assert tuple(df.select(body, error).first()) == ("[no text could be extracted: f]", "broken")


def test_reply(spark):
    df = spark.createDataFrame([('say\n```json\n{"extracted_text": "t", "content_type": "chart"}\n```',), ('{"description": "d"}',), ("no json",)], "r string")
    assert [tuple(r[0]) for r in df.select(ingest.parse_reply(F.col("r"))).collect()] == [("t", "", "chart"), ("", "d", "other"), ("no json", "no json", "unknown")]


def test_images(spark):
    df = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n.."),), (bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b"hello"),)], "c binary")
    assert [r[0] for r in df.select(ingest.image_kind(F.col("c"))).collect()] == ["png", "jpeg", None]
    rows = spark.createDataFrame([("d", p, i) for p in (0, 1, 11) for i in range(4)], "document_id string, page int, idx int")
    assert [(r["page"], r["idx"]) for r in ingest.first_images(rows).orderBy("page", "idx").collect()] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0)]


def test_enhancement_korean(spark):
    df = spark.createDataFrame([("1", "돈 얼마나 필요한가요"), ("2", "돈이 얼마나"), ("3", "보안 인증"), ("4", "")], "query_id string, query string")
    found = {r["query_id"]: r for r in enhance.enhance(df).collect()}
    assert found["1"]["standardized_query"] == "예산 기간 필요한가요" and found["2"]["standardized_query"] == "돈이 기간"
    assert found["1"]["detected_intent"] == "budget" and found["1"]["enhanced_query"] == "예산 기간 필요한가요 비용 금액 스케줄 계획"
    assert found["3"]["detected_intent"] == "security" and found["3"]["suggested_alternatives"] == L.TEMPLATES_KO["보안"][:3]
    assert found["4"]["confidence_improvement"] == 0.0 and found["4"]["enhanced_query"] == ""


def test_context_and_hints(spark):
    df = spark.createDataFrame([("a", "안드로이드 앱"), ("웹사이트 b", "웹사이트"), ("c", None)], "q string, c string")
    assert [r[0] for r in df.select(enhance.with_context(F.col("q"), F.col("c"), enhance.KOREAN)).collect()] == ["a 모바일", "웹사이트 b", "c"]
    rows = spark.createDataFrame([("1", "x", "x y", "general", 2, 0.2), ("2", "x", "x", "general", 0, 0.0), ("3", "x", "x", "budget", 3, 0.9)], "query_id string, query string, enhanced_query string, detected_intent string, n_sources int, mean_score double")
    assert [r["hints"] for r in enhance.better_questions(rows).orderBy("query_id").collect()] == ["ask a more specific question / add a related keyword / try: x y", "use more specific keywords", ""]


def test_two_pass_keeps_the_better(spark):
    first = spark.createDataFrame([("1", 0.9, 3), ("2", 0.2, 1), ("3", 0.5, 3)], "query_id string, confidence double, n_sources int")
    asked = spark.createDataFrame([(q, "x", "y") for q in "123"], "query_id string, query string, enhanced_query string")
    again = lambda q: q.select("query_id", F.when(F.col("query_id") == "2", 0.7).otherwise(0.1).alias("confidence"), F.lit(2).alias("n_sources"))
    found = [(r["query_id"], r["confidence"], r["enhanced"]) for r in enhance.two_pass(first, again, asked).orderBy("query_id").collect()]
    assert found == [("1", 0.9, False), ("2", 0.7, True), ("3", 0.5, False)]


def test_confidence_without_results_is_zero(spark):
    queries = spark.createDataFrame([("1",), ("2",)], "query_id string")
    results = spark.createDataFrame([("1", "a", 0.5), ("1", "b", 0.4)], "query_id string, id string, score double")
    assert [(r[0], round(r[1], 6)) for r in fusion.generic_confidence(queries, results).orderBy("query_id").collect()] == [("1", round(0.45 * 1.1, 6)), ("2", 0.0)]


def test_bm25_by_hand(spark):
    import math

    chunks = spark.createDataFrame([("a", "d", "x x y"), ("b", "d", "y z"), ("c", "d", "")], "chunk_id string, document_id string, content string")
    queries = spark.createDataFrame([(1, "x x q")], "query_id int, query string")
    r = bm25.search(chunks, queries).collect()
    idf, avg = math.log((3 - 1 + 0.5) / 1.5 + 1), 5 / 3
    assert [(x["chunk_id"], x["bm25"]) for x in r] == [("a", round(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)), 6))]


def test_bm25_in_parts(spark, sf):
    from sheaf.sources.tables import corpus, questions

    chunks, asked = chunking.smart_chunks(corpus(spark, sf)), questions(spark, sf)
    held = bm25.matches(chunks, asked)
    few, many = (sorted(map(tuple, bm25.ranked(held, asked, 7, rows=n).select("query_id", "chunk_id", "bm25", "rank").collect())) for n in (10**9, 500))
    assert few == many and len(few) == 7 * asked.count()
    assert bm25.ranked(held, asked.limit(0), 7).count() == 0


def test_lsh_recall(spark, sf):
    from sheaf.sources.tables import questions
    from sheaf.sources.tables import vectors as table

    exact, near = vectors.knn(table(spark, sf), questions(spark, sf), 10), vectors.knn_lsh(table(spark, sf), questions(spark, sf), 10)
    assert exact.join(near, ["query_id", "id"]).count() >= 0.9 * exact.count()


def test_dimension_is_checked(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<float>")
    with pytest.raises(ValueError):
        vectors.check_dimension(df)


def test_neighbours_in_parts(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v, q = rng.integers(-3, 4, (300, 4)).astype(float), rng.integers(-3, 4, (70, 4)).astype(float)
    table = spark.createDataFrame([(f"v{i}", x.tolist()) for i, x in enumerate(v)], "id string, embedding array<float>")
    asked = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(q)), (999, None)], "query_id int, qvec array<float>")
    expected = {(i, n, d, r + 1) for i, x in enumerate(q) for r, (d, n) in enumerate(sorted((float(((v[j] - x) ** 2).sum()), f"v{j}") for j in range(300))[:7])}
    for found in (vectors.knn(table, asked, 7), vectors.knn(table, asked, 7, rows=40), vectors.knn_sql(table, asked, 7, rows=40)):
        assert {(r["query_id"], r["id"], r["distance"], r["rank"]) for r in found.collect()} == expected
    assert vectors.knn(table.limit(0), asked, 7).count() == vectors.knn(table, asked.limit(0), 7).count() == 0 and vectors.knn(table.limit(3), asked, 7).count() == 210


def test_regions_of_a_plausible_size(spark):
    # page of 600 x 500: over 500 and under 240,000 square; wider than 20, higher than 10; ink between 0.01 and 0.95
    boxes = [(21, 24, 0.5), (20, 30, 0.5), (60, 10, 0.5), (21, 211, 0.5), (600, 450, 0.5), (500, 400, 0.01), (500, 400, 0.95), (30, 17, 0.02), (25, 20, 0.5), (600, 11, 0.5)]
    df = spark.createDataFrame([("d", 0, i, 0, 0, w, h, ink) for i, (w, h, ink) in enumerate(boxes)], "document_id string, page_number int, elem_idx int, x1 int, y1 int, x2 int, y2 int, density double")
    assert [(r["elem_idx"], r["area"]) for r in layout.text_regions(df, 300_000).orderBy("area_rank").collect()] == [(9, 6600), (7, 510), (0, 504)]
    assert sorted(r["elem_idx"] for r in layout.text_regions(df, 600_000).collect()) == [4, 9]  # a thousandth and 80 % of a larger page


def test_labels_by_rule(spark):
    cases = [
        ("1. 개요", 0.0, 0, 0, 0, "title", 0.85), ("1.개요" + "가" * 100, 0.0, 0, 0, 0, "subtitle", 0.75), ("제 3 항", 0.9, 9, 0, 0, "title", 0.85), ("예산 : 5", 0, 0, 0, 0, "title", 0.85), ("【일정】 x", 0, 0, 0, 0, "title", 0.85), (" ■ 항목", 0, 0, 0, 0, "title", 0.85),
        ("- a", 0, 0, 0, 0, "list", 0.8), (" 3) b", 0, 0, 0, 0, "list", 0.8), ("-a", 0, 0, 0, 0, "text", 0.5), ("a │ b", 0, 0, 0, 0, "table", 0.9), ("a | b", 0, 0, 0, 0, "text", 0.5), ("1. 개요", 0, 0, 2, 2, "table", 0.9),
        ("Plain Words", 0.4, 6, 2, 1, "paragraph", 0.7), ("plain", 0.4, 5, 0, 0, "text", 0.6), ("plain", 0.3, 9, 0, 0, "text", 0.5), ("1.2 x", 0, 0, 0, 0, "text", 0.5),
    ]
    df = spark.createDataFrame([(t, float(d), n, h, v) for t, d, n, h, v, _, _ in cases], "t string, d double, n int, h int, v int")
    found = df.select(*layout.rule_label(*[F.col(c) for c in "tdnhv"])).collect()
    assert [tuple(r) for r in found] == [c[5:] for c in cases]
    conf = df.select(*layout.combined_label(F.lit("list"), F.lit(0.8), F.lit("m"), F.lit(0.71)), *layout.combined_label(F.lit("text"), F.lit(0.3), F.lit("m"), F.lit(0.7))).first()
    assert tuple(conf) == ("m", 0.71, "text", 0.5)


def test_fonts(spark):
    df = spark.createDataFrame([(20, 4, 0.16), (40, 1, 0.15), (40, 0, 0.0)], "h int, n int, s double")
    assert [tuple(r) for r in df.select(*layout.font_info(F.col("h"), F.col("n"), F.col("s"))).collect()] == [(8.0, 5.0, True), (30.0, 40.0, False), (30.0, 40.0, False)]


def test_reading_order_halves_the_way_to_each_top(spark):
    # heights 0, 10, 19, 28.5: 38 is within 20 of the third, and would not be of the mean of 0, 20 and 28
    tops = [(0, 300), (20, 100), (28, 200), (38, 0), (49, 50), (49, 10)]
    df = spark.createDataFrame([("d", 0, i, x, y) for i, (y, x) in enumerate(tops)], "document_id string, page_number int, elem_idx int, x1 int, y1 int")
    assert [(r["elem_idx"], r["row"]) for r in layout.reading_order(df).orderBy("reading_order").collect()] == [(3, 0), (1, 0), (2, 0), (0, 0), (5, 1), (4, 1)]


def test_kinds_of_pages_and_columns(spark):
    pages = {0: [100] * 5, 1: [100] * 4 + [500], 2: [100] * 3 + [300] * 2 + [500], 3: [450] * 3, 4: [200, 100, 100, 100, 100, 100], 5: [100, 400, 250]}
    df = spark.createDataFrame([("d", p, i, c - 10, c + 10) for p, cs in pages.items() for i, c in enumerate(cs)], "document_id string, page_number int, elem_idx int, x1 int, x2 int")
    assert [r["layout_type"] for r in layout.layout_type(df).orderBy("page_number").collect()] == ["single_column", "two_column", "complex", "complex", "single_column", "complex"]
    assert [r["columns"] for r in layout.column_count(df).orderBy("page_number").collect()] == [1, 2, 3, 1, 2, 3]


def test_document_summary(spark):
    rows = [(1, 0, 0, 0, 100, "title", "B", 0.5, 0.25), (1, 1, 0, 0, 100, "text", " ", 0.5, 0.25), (1, 2, 300, 5, 560, "text", "C", 1.0, 0.5), (2, 0, 0, 0, 90, "list", "A", 0.0, 0.0)]
    df = spark.createDataFrame([("d", *r) for r in rows], "document_id string, page_number int, elem_idx int, x1 int, y1 int, x2 int, label string, text_content string, confidence double, ocr_confidence double")
    r = layout.document_summary(df).first()
    assert r["extracted_text"] == "\n[페이지 1]\n[TITLE] B\n[TEXT] C\n\n[페이지 2]\n[LIST] A\n"
    assert (r["total_pages"], r["total_elements"], r["element_types"], r["avg_confidence"], r["avg_ocr_confidence"]) == (2, 4, {"list": 1, "text": 2, "title": 1}, 0.5, 0.25)
    assert (r["layout_types"], r["column_info"]) == (["two_column", "single_column"], [2, 1]) or r["layout_types"] == ["complex", "single_column"]
    assert r["complexity_score"] == pytest.approx(0.25 * 3 / 8 + 0.25 * r["layout_types"].count("complex") / 2 + 0.25 * 4 / 20000 + 0.25 * 0.75)


def test_types_of_groups(spark):
    groups = {"a": ["title"], "b": ["title", "paragraph"], "c": ["list", "list"], "d": ["title", "list"], "e": ["title", "list", "paragraph"], "f": ["title", "table", "list"], "g": ["list", "list", "paragraph"]}
    rows = [(g, i, k, "x", 10.0, "normal", 0) for g, kinds in groups.items() for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "document_id string, elem_idx int, element_type string, text_content string, font_size double, font_weight string, page_number int")
    assert {r["document_id"]: r["chunk_type"] for r in chunking.group_summary(df, []).collect()} == {"a": "title", "b": "content", "c": "list", "d": "content", "e": "mixed", "f": "table", "g": "content"}


def test_lines_that_a_chunk_may_be_cut_before(spark):
    good = ["1. 제목", "2. Title", "제 2 장", "제3장 끝", "전체 사업 개요", "세부기술요구사항", "(가) x", "나. x", "7) x"]
    bad = ["- x", "• x", "# x", "[일정]", "제 2 조", "사업 개요", "1.2 x", "(1) x", "x 1. 제목"]
    df = spark.createDataFrame([(x,) for x in good + bad], "t string")
    found = [r[0] for r in df.select(F.col("t").rlike(f"(?:{chunking.STRONG})|(?:{chunking.MEDIUM})")).collect()]
    assert found == [True] * len(good) + [False] * len(bad)


def test_packing_counts_the_blanks(spark):
    df = spark.createDataFrame([("aa. bb. cc.",), ("",), ("  ",)], "t string")
    pick = lambda n: [r[0] for r in df.select(chunking.emergency_split(F.col("t"), n)).collect()]
    assert pick(7) == [["aa. bb.", "cc."], [], []] and pick(6) == [["aa.", "bb. cc."], [], []]


def test_agency_signs_numbers_and_case(spark):
    df = spark.createDataFrame([("발주기관: 국민-연금*공단 (본부)",), ("발주기관: 12345\n발주처: 시청",), ("발주기관: ***\n발주처: 시청",), ("the MIT license",)], "t string")
    assert [r[0] for r in df.select(metadata.agency(F.col("t"), [*L.AGENCY_KO, "the ([A-Z]+) License"])).collect()] == ["국민연금공단 (본부)", "시청", None, "MIT"]


def test_business_type_whatever_the_case(spark):
    df = spark.createDataFrame([("isp 수립", "f"), ("x", "Erp 구축.hwp")], "t string, n string")
    assert [r[0] for r in df.select(metadata.business_type(F.col("t"), F.col("n"))).collect()] == ["ISP/ISMP", "ERP구축"]


def test_confidence_of_two_searches(spark):
    queries = spark.createDataFrame([(i,) for i in range(5)], "query_id int")
    best = spark.createDataFrame([(0, 0.5, 0.4), (1, 0.5, 0.2), (2, 0.5, 0.05), (3, 0.9, 1.0)], "query_id int, v double, w double")
    found = {r[0]: round(r[1], 9) for r in fusion.hybrid_confidence(queries, best).collect()}
    assert found == {0: round(1.1 * (0.35 + 0.12) * 1.05, 9), 1: 0.525, 2: 0.5, 3: 1.0, 4: 0.0}


def test_union_fusion(spark):
    v = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 11, 0.4)], "query_id int, id string, rank int, score double")
    w = spark.createDataFrame([(1, "a", 2, 0.5)], "query_id int, id string, rank int, score double")
    found = [(r["id"], r["source"], r["combined_score"]) for r in fusion.union_fusion(v, w).orderBy("rank").collect()]
    assert found == [("a", "vector", round((0.5 + 0.1) / 1.1 * 0.7, 6)), ("b", "vector", round(0.4 / 1.1 * 0.7, 6)), ("a", "keyword", round((0.5 + 0.09) / 1.1 * 0.3, 6))]


def test_patterns_of_searches(spark):
    log = spark.createDataFrame([(1, "예산 PLAN", "m", 0.5, 1.0, 1), (2, "Plan", "m", None, 1.0, 2), (3, "other", "m", 1.0, 1.0, 3)], "id int, query string, search_method string, confidence_score double, response_time double, ts int")
    found = {(r["metric"], r["name"]): r["value"] for r in analytics.patterns(log, {"money": ["예산"], "plan": ["plan"]}).collect()}
    assert found[("category", "money")] == 1 and found[("category", "plan")] == 1 and not any(n == "other" for m, n in found if m == "category")
    assert found[("word", "plan")] == 2 and found[("mean_confidence", "")] == 0.5 and found[("total", "")] == 3


def test_second_pass_only_for_other_texts(spark):
    first = spark.createDataFrame([("1", 0.1, 0), ("2", 0.1, 0)], "query_id string, confidence double, n_sources int")
    asked = spark.createDataFrame([("1", "x", "x"), ("2", "x", "y")], "query_id string, query string, enhanced_query string")
    again = lambda q: q.select("query_id", F.lit(0.7).alias("confidence"), F.lit(2).alias("n_sources"))
    assert [(r["query_id"], r["enhanced"]) for r in enhance.two_pass(first, again, asked).orderBy("query_id").collect()] == [("1", False), ("2", True)]


def test_refresh_equals_a_new_index(spark):
    old = spark.createDataFrame([("a", "x y"), ("b", "y y z")], "chunk_id string, content string")
    new = spark.createDataFrame([("b", "w"), ("c", "")], "chunk_id string, content string")
    posted, dl = bm25.refresh(bm25.postings(old), bm25.lengths(old), new)
    every = spark.createDataFrame([("a", "x y"), ("b", "w"), ("c", "")], "chunk_id string, content string")
    assert sorted(map(tuple, posted.collect())) == sorted(map(tuple, bm25.postings(every).collect())) and bm25.size_of(dl).first() == bm25.corpus_size(every).first()


def test_reading_order_joins_rows_by_running_mean(spark):
    rows = [("d", 0, 0, 300, 5), ("d", 0, 1, 0, 12), ("d", 0, 2, 0, 60), ("d", 0, 3, 300, 50)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, elem_idx int, x1 int, y1 int")
    assert [(r["elem_idx"], r["row"]) for r in layout.reading_order(df).orderBy("reading_order").collect()] == [(1, 0), (0, 0), (2, 1), (3, 1)]


def test_files_and_metadata_import(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("in/a.txt", "in/sub/b.html", "in/c.zip"):
        (tmp_path / name).write_text("x")
    found = ingest.scan_files(spark, str(tmp_path / "in"), [".txt", ".html"]).select("file_name", "error_message", "length").orderBy("file_name").collect()
    assert [(r[0], r[1], r[2]) for r in found] == [("a.txt", None, 1), ("b.html", None, 1), ("c.zip", "unsupported file type: .zip", 1)]
    (tmp_path / "m.csv").write_text("﻿파일명,발주기관,예산\na.txt,시청,10\nb.txt,구청,\na.txt,중복,1\n", encoding="utf-8")
    none = spark.createDataFrame([], "document_id string, file_name string, agency string")
    rows = ingest.import_metadata(spark, str(tmp_path / "m.csv"), none).orderBy("file_name").collect()
    assert [(r["file_name"], r["agency"]) for r in rows] == [("a.txt", "시청" if "시청" < "중복" else "중복"), ("b.txt", "구청")]
    again = ingest.import_metadata(spark, str(tmp_path / "m.csv"), spark.createDataFrame([(r["document_id"], r["file_name"], "old") for r in rows], "document_id string, file_name string, agency string"))
    assert again.count() == 2 and {r["agency"] for r in again.collect()} == {"old"}


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("1", "a", "2024-01-01"), ("2", "b", "2024-02-01")], "document_id string, agency string, processed_date string")
    ingest.export_documents(docs, str(tmp_path / "csv"), ["document_id", "agency", "processed_date"])
    assert [r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["2", "1"]
    ingest.snapshot({"docs": docs}, str(tmp_path / "snap"), 7)
    assert spark.read.parquet(str(tmp_path / "snap/docs")).first()["snapshot_ts"] == 7
    answers = spark.createDataFrame([("q", "hybrid", 3, 0.5)], "query string, search_method string, total_results int, confidence double")
    for _ in range(2):
        ingest.append_log(answers, str(tmp_path / "log"), F.lit("2024-01-01").cast("timestamp"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_like_takes_signs_as_they_are(spark):
    df = spark.createDataFrame([("a%b", "t"), ("axb", "t"), ("A_B", "t")], "agency string, title string")
    assert [r[0] for r in analytics.filter_documents(df, agency="A%").collect()] == ["a%b"]
    assert [r[0] for r in analytics.filter_documents(df, agency="a_").collect()] == ["A_B"]


def test_rank_fusion_and_custom_embedder(spark):
    v = spark.createDataFrame([(1, "a", 0.0, 1), (1, "b", 1.0, 2)], "query_id int, id string, distance double, rank int")
    w = spark.createDataFrame([(1, "b", 15.0, 1)], "query_id int, id string, bm25 double, rank int")
    assert [r["id"] for r in fusion.hybrid(v, w, fusion="rrf").orderBy("rank").collect()] == ["b", "a"]
    rows = spark.createDataFrame([("x",), ("xyz",)], "content string")
    assert [list(r["embedding"]) for r in vectors.embed(rows, embedder=lambda b: [[float(len(t))] for t in b]).collect()] == [[1.0], [3.0]]


def test_means_of_tokens_do_not_hang_on_their_order(spark):
    """The mean is 4/7, of which seven tenths are a token's confidence; added up from the end it comes out a last place lower."""
    from sheaf.operators import layout

    conf = [0.7, 0.1, 0.3, 0.8, 0.6, 0.7, 0.9, 0.4, 0.8, 0.5, 0.4, 0.4, 0.8, 0.6]
    rows = [("d", i, f"t{i}", c) for i, c in enumerate(conf)]
    for some in (rows, rows[::-1]):
        tokens = spark.createDataFrame([*some, ("e", 0, "x", None)], "document_id string, pos int, token string, conf double").coalesce(1)
        found = {r["document_id"]: (r["text"], round(r["ocr_confidence"], 6)) for r in layout.merge_tokens(tokens, ["document_id"]).collect()}
        assert found == {"d": ("t0 t3 t4 t5 t6 t8 t9 t12 t13", round(6.4 / 9, 6)), "e": ("", 0.0)}


def test_keywords_shuffle_no_words(spark):
    from sheaf.operators import chunking

    df = spark.createDataFrame([("a", "one two two 가나 가나"), ("a", "two one one"), ("b", "12 x"), ("c", None)], "document_id string, content string")
    found = chunking.keywords(df, top=2)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("a", "two,one")]
