"""Analytics of detected page regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import strip

PAGE = ["document_id", "page_number"]


def text_regions(regions: DataFrame, page_area: float, top: int = 15) -> DataFrame:
    """Regions of a plausible size, shape and ink density; the largest of each page.

    An area lies between the larger of 500 and a thousandth of the page's, and 80 % of it.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sized = regions.withColumn("area", w * h).where((F.col("area") > max(500.0, page_area * 0.001)) & (F.col("area") < page_area * 0.8))
    kept = sized.where((w / h > 0.1) & (w / h < 100) & (w > 20) & (h > 10) & (F.col("density") > 0.01) & (F.col("density") < 0.95))
    return kept.withColumn("area_rank", F.row_number().over(W.partitionBy(*PAGE).orderBy(F.desc("area"), "elem_idx"))).where(F.col("area_rank") <= top)


def merge_tokens(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Recognised tokens over an adaptive threshold, stripped and joined, with their mean confidence. tokens: keys, pos, token, conf.

    Confidences are added up within the row in the order of pos, so that a mean on a threshold or between two last places does not
    hang on the order in which tokens arrive.
    """
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["conf"]) / F.nullif(F.size(xs), F.lit(0))
    known = F.when(F.col("conf").isNotNull(), F.struct("pos", F.col("conf").cast("double").alias("conf"), strip(F.col("token")).alias("token")))
    rows = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(known)).alias("_t")).withColumn("_mean", mean(F.col("_t")))
    over = lambda least: F.filter("_t", lambda x: x["conf"] > least)
    high, low = over(F.greatest(F.lit(0.3), F.least(F.lit(0.7), 0.7 * F.col("_mean")))), over(F.greatest(F.lit(0.2), 0.5 * F.col("_mean")))
    rows = rows.withColumn("_high", high).select(*keys, F.when(F.size("_high") > 0, F.col("_high")).otherwise(low).alias("_t"))
    return rows.select(*keys, F.array_join(F.transform("_t", lambda x: x["token"]), " ").alias("text"), F.coalesce(mean(F.col("_t")), F.lit(0.0)).alias("ocr_confidence"))


#: How a title begins, and how an entry of a list does.
TITLES = (r"(?U)^\d+\.\s*[가-힣A-Za-z]+", r"(?U)^제\s*\d+\s*[장절항]", r"(?U)^[가-힣]+\s*[:：]\s*", r"^【.+】", r"(?U)^\s*[◆◇▣▢■□●○]\s*.+")
LISTS = (r"(?U)^\s*[-*•]\s+", r"(?U)^\s*\d+\)\s+")
TABLE_SIGNS = ("│", "┌", "├")


def rule_label(text: Column, density: Column, n_lines: Column, h_lines: Column, v_lines: Column) -> tuple[Column, Column]:
    """(label, confidence) by rule: drawn lines or box signs, a title's beginning (long ones are subtitles), an entry of a list, the density of ink."""
    any_of = lambda conditions: F.greatest(*conditions)  # noqa: E731  true if one is
    table = ((h_lines >= 2) & (v_lines >= 2)) | any_of([F.contains(text, F.lit(s)) for s in TABLE_SIGNS])
    title = any_of([text.rlike(p) for p in TITLES])
    entry = any_of([text.rlike(p) for p in LISTS])
    short, dense, many = F.length(text) < 100, density > 0.3, n_lines > 5
    label = F.when(table, "table").when(title & short, "title").when(title, "subtitle").when(entry, "list").when(dense & many, "paragraph").otherwise("text")
    conf = F.when(table, 0.9).when(title & short, 0.85).when(title, 0.75).when(entry, 0.8).when(dense & many, 0.7).when(dense, 0.6).otherwise(0.5)
    return label, conf


def combined_label(rule: Column, rule_conf: Column, model: Column, model_conf: Column) -> tuple[Column, Column]:
    """A sure rule, else a sure model, else the rule with confidence 0.5 at least."""
    by_rule, by_model = rule_conf > 0.8, model_conf > 0.7
    return F.when(by_rule, rule).when(by_model, model).otherwise(rule), F.when(by_rule, rule_conf).when(by_model, model_conf).otherwise(F.greatest(rule_conf, F.lit(0.5)))


def font_info(height: Column, n_lines: Column, stroke_ratio: Column) -> tuple[Column, Column, Column]:
    """(size in points, 8 at least; line height; bold)."""
    line = height / F.greatest(n_lines, F.lit(1))
    return F.greatest(F.lit(8.0), line * 0.75), line, stroke_ratio > 0.15


def in_reading_order(items: Column, tolerance: int = 20) -> Column:
    """An array of structs that begin with y1 (sorted by it), with x1: the same with `row` and in reading order.

    A row has a height: the first top in it, then the mean of that and each top that joins. A top joins if it is not
    farther than the tolerance; otherwise it begins a row. Rows go from top to bottom, each from left to right.
    """
    start = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("y"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, x: Column) -> Column:
        same = F.abs(x["y1"] - s["y"]) <= tolerance
        row = F.when(same, s["row"]).otherwise(s["row"] + 1)
        return F.struct(row.alias("row"), F.when(same, (s["y"] + x["y1"]) / 2).otherwise(x["y1"].cast("double")).alias("y"), F.concat(s["rows"], F.array(row)).alias("rows"))

    rows = F.aggregate(items, start, step)["rows"]
    placed = F.zip_with(rows, items, lambda r, x: F.struct(r.alias("row"), x["x1"].alias("x1"), x["y1"].alias("y1"), x["elem_idx"].alias("elem_idx"), x.alias("item")))
    return F.sort_array(placed)


def reading_order(regions: DataFrame, tolerance: int = 20) -> DataFrame:
    """The place of each region in its page's reading order, and its row."""
    pages = regions.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("y1", "elem_idx", "x1"))).alias("items"))
    ordered = pages.select(*PAGE, F.posexplode(in_reading_order(F.col("items"), tolerance)).alias("reading_order", "_i"))
    return ordered.select(*PAGE, F.col("_i.elem_idx").alias("elem_idx"), "reading_order", F.col("_i.row").alias("row"))


def kind_of_page(n: Column, left: Column, middle: Column, right: Column) -> Column:
    """By the thirds of the page in which the regions' centres lie."""
    return F.when(n == 0, "empty").when(left / n > 0.8, "single_column").when((left > 0) & (right > 0) & (middle / n < 0.3), "two_column").otherwise("complex")


def layout_type(regions: DataFrame, width: int = 600) -> DataFrame:
    center = (F.col("x1") + F.col("x2")) / 2
    left, right = center < width / 3, center >= width * 2 / 3
    agg = regions.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.count_if(left).alias("l"), F.count_if(~left & ~right).alias("m"), F.count_if(right).alias("r"))
    return agg.select(*PAGE, "n", kind_of_page(F.col("n"), F.col("l"), F.col("m"), F.col("r")).alias("layout_type"))


def columns_of(centers: Column, width: int) -> Column:
    """1 and a column more for each gap over a tenth of the width between neighbouring (sorted) centres, 3 at most."""
    gaps = F.zip_with(F.slice(centers, 1, F.size(centers) - 1), F.slice(centers, 2, F.size(centers)), lambda a, b: b - a)
    return F.when(F.size(centers) < 2, 1).otherwise(F.least(F.lit(1) + F.size(F.filter(gaps, lambda g: g > 0.1 * width)), F.lit(3))).cast("long")


def column_count(regions: DataFrame, width: int = 600) -> DataFrame:
    centers = F.sort_array(F.collect_list((F.col("x1") + F.col("x2")) / 2))
    return regions.groupBy(*PAGE).agg(centers.alias("c")).select(*PAGE, columns_of(F.col("c"), width).alias("columns"))


def document_summary(regions: DataFrame, width: int = 600, marker: str = "\n[페이지 %d]\n") -> DataFrame:
    """A row for each document, from regions with a label: counts, mean confidences, text in reading order under page marks, layouts, columns, complexity.

    A page is put into order within its row, and a document's pages within its: two shuffles of the regions' texts.
    """
    item = F.struct("y1", "elem_idx", "x1", "x2", "label", "text_content")
    pages = regions.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum("confidence").alias("c"), F.sum("ocr_confidence").alias("o"), F.sum(F.length("text_content")).alias("chars"))
    centers = F.sort_array(F.transform("items", lambda x: (x["x1"] + x["x2"]) / 2))
    within = lambda f: F.size(F.filter("_centers", f))
    said = F.filter(F.transform(in_reading_order(F.col("items")), lambda x: x["item"]), lambda x: x["text_content"].rlike(r"\S"))
    body = F.array_join(F.transform(said, lambda x: F.concat(F.lit("["), F.upper(x["label"]), F.lit("] "), x["text_content"], F.lit("\n"))), "")
    kind = kind_of_page(F.size("items"), within(lambda c: c < width / 3), within(lambda c: (c >= width / 3) & (c < width * 2 / 3)), within(lambda c: c >= width * 2 / 3))
    pages = pages.withColumn("_centers", centers).select(
        "document_id", F.size("items").alias("n"), "c", "o", "chars", F.transform("items", lambda x: x["label"]).alias("labels"),
        F.struct("page_number", kind.alias("kind"), columns_of(F.col("_centers"), width).alias("columns"), F.concat(F.format_string(marker, F.col("page_number")), body).alias("text")).alias("p"),
    )
    docs = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_pages"), F.sum("n").alias("total_elements"), F.sum("c").alias("c"), F.sum("o").alias("o"), F.sum("chars").alias("n_chars"),
        F.flatten(F.collect_list("labels")).alias("labels"), F.sort_array(F.collect_list("p")).alias("p"),
    )
    counts = F.transform(F.array_sort(F.array_distinct("labels")), lambda k: F.struct(k.alias("key"), F.size(F.filter("labels", lambda x: x == k)).alias("value")))
    rows = docs.select(
        "document_id", "total_pages", "total_elements", F.map_from_entries(counts).alias("element_types"), (F.col("c") / F.col("total_elements")).alias("avg_confidence"), (F.col("o") / F.col("total_elements")).alias("avg_ocr_confidence"),
        F.array_join(F.transform("p", lambda x: x["text"]), "").alias("extracted_text"), F.transform("p", lambda x: x["kind"]).alias("layout_types"), F.transform("p", lambda x: x["columns"]).alias("column_info"), "n_chars",
    )
    return rows.withColumn("complexity_score", complexity(F.size("element_types"), F.size(F.filter("layout_types", lambda k: k == "complex")) / F.col("total_pages"), F.col("n_chars"), F.col("avg_ocr_confidence")))


def complexity(n_types: Column, complex_share: Column, n_chars: Column, mean_ocr: Column) -> Column:
    """Mean of the diversity of types, the share of complex pages, the volume of text and the missing OCR confidence."""
    return F.least(n_types / 8.0, F.lit(1.0)) * 0.25 + complex_share * 0.25 + F.least(n_chars / 20000.0, F.lit(1.0)) * 0.25 + (1 - mean_ocr) * 0.25
