"""Query enhancement: intent, vocabulary, synonyms, context; recommended questions."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import lexicon as L
from ..functions.text import words


class Lexicon(NamedTuple):
    thesaurus: dict[str, list[str]]
    vocabulary: list[tuple[str, str]]
    intents: list[tuple[str, list[str], list[str], str]]
    contexts: dict[str, list[str]]
    templates: dict[str, list[str]]
    category_of: dict[str, str]
    stopwords: list[str]
    high: list[str]
    medium: list[str]


KOREAN = Lexicon(L.THESAURUS_KO, L.VOCABULARY_KO, L.INTENTS_KO, L.CONTEXTS_KO, L.TEMPLATES_KO, L.CATEGORY_OF_KO, L.STOPWORDS_KO, L.HIGH_KO, L.MEDIUM_KO)
LATIN = Lexicon(L.THESAURUS_LATIN, L.VOCABULARY_LATIN, L.INTENTS_LATIN, L.CONTEXTS_LATIN, L.TEMPLATES_LATIN, L.CATEGORY_OF_LATIN, L.STOPWORDS_LATIN, L.HIGH_LATIN, L.MEDIUM_LATIN)


def any_of(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def tokens(text: Column) -> Column:
    """Runs of word characters as they are."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def intent(text: Column, lex: Lexicon) -> Column:
    out = F.lit("general")
    for name, shown, _, _ in reversed(lex.intents):
        out = F.when(any_of(text, shown), F.lit(name)).otherwise(out)
    return out


def density(text: Column) -> Column:
    """Words per character."""
    return F.when(F.length(text) > 0, F.size(tokens(text)) / F.length(text)).otherwise(F.lit(0.0))


def standardise(text: Column, lex: Lexicon) -> Column:
    """Whole words replaced, one pair after another."""
    for plain, formal in lex.vocabulary:
        text = F.regexp_replace(text, rf"(?U)\b{re.escape(plain)}\b", formal)
    return text


def synonyms(word: Column, lex: Lexicon, most: int = 3) -> Column:
    """Up to `most` others of the first entry whose head or member the word is."""
    table = {}
    for head, members in lex.thesaurus.items():
        for w in [head, *members]:
            table.setdefault(w, [m for m in members if m != w])
    at = F.create_map(*[x for w, others in table.items() for x in (F.lit(w), strings(others[:most]))])
    return F.coalesce(F.try_element_at(at, word), strings([]))


def expand(text: Column, lex: Lexicon) -> Column:
    """The first two synonyms of each word behind the text."""
    more = F.flatten(F.transform(tokens(text), lambda w: F.slice(synonyms(w, lex), 1, 2)))
    return F.when(F.size(more) > 0, F.concat(text, F.lit(" "), F.array_join(more, " "))).otherwise(text)


def with_context(text: Column, context: Column, lex: Lexicon) -> Column:
    """The first area that the context mentions is added if the text has none of its words."""
    out = text
    low_context, low = F.lower(F.coalesce(context, F.lit(""))), F.lower(text)
    for area, members in reversed(list(lex.contexts.items())):
        members = [m.lower() for m in members]
        out = F.when(any_of(low_context, members), F.when(any_of(low, members), text).otherwise(F.concat(text, F.lit(f" {area}")))).otherwise(out)
    return out


def with_intent(text: Column, intent: Column, lex: Lexicon) -> Column:
    out = text
    for name, _, strong, _ in lex.intents:
        out = F.when((intent == name) & ~any_of(text, strong), F.concat(text, F.lit(f" {strong[0]}"))).otherwise(out)
    return out


def improvement(original: Column, enhanced: Column) -> Column:
    n = F.size(tokens(original))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least((F.size(tokens(enhanced)) - n) / n, F.lit(1.0)))


def alternatives(intent: Column, lex: Lexicon, most: int = 3) -> Column:
    out = strings([])
    for name, _, _, category in lex.intents:
        out = F.when(intent == name, strings(lex.templates.get(category, [])[:most])).otherwise(out)
    return out


def enhance(queries: DataFrame, lex: Lexicon = KOREAN, context: Column | None = None) -> DataFrame:
    """Adds the detected intent, the standardised and the enhanced query, its new words, the gain, and alternatives."""
    q = F.col("query")
    rows = queries.withColumn("detected_intent", intent(q, lex)).withColumn("standardized_query", standardise(q, lex))
    rows = rows.withColumn("_expanded", expand(F.col("standardized_query"), lex))
    rows = rows.withColumn("_context", with_context(F.col("_expanded"), context, lex) if context is not None else F.col("_expanded"))
    rows = rows.withColumn("enhanced_query", with_intent(F.col("_context"), F.col("detected_intent"), lex))
    return rows.withColumns({
        "expanded_terms": F.array_sort(F.array_except(tokens(F.col("enhanced_query")), tokens(q))),
        "confidence_improvement": improvement(q, F.col("enhanced_query")), "suggested_alternatives": alternatives(F.col("detected_intent"), lex),
    }).drop("_expanded", "_context")


def domain_weight(word: Column, lex: Lexicon) -> Column:
    members = sorted({m for ms in lex.thesaurus.values() for m in ms})
    return F.when(word.isin(lex.high), 3.0).when(word.isin(lex.medium), 2.0).when(word.isin(members), 1.5).otherwise(1.0)


def main_keywords(docs: DataFrame, lex: Lexicon = KOREAN, key: str = "document_id", text: str = "content", top: int = 30) -> DataFrame:
    """Words of two characters at least, twice at least, no stop words: their share of all kept words times the domain weight; the best of each document."""
    plain = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    kept = F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(lex.stopwords))
    rows = docs.select(key, kept.alias("_w")).select(key, F.size("_w").alias("_all"), F.explode("_w").alias("word"))
    counted = rows.groupBy(key, "_all", "word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    scored = counted.select(key, "word", "n", F.round(F.col("n") / F.col("_all") * domain_weight(F.col("word"), lex), 9).alias("weight"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("weight"), "word"))).where(F.col("rank") <= top)


def category(word: Column, lex: Lexicon) -> Column:
    """The category of the first entry with a category that has the word."""
    out = F.lit(None).cast("string")
    for head, members in reversed(list(lex.thesaurus.items())):
        if head in lex.category_of:
            out = F.when(word.isin([head, *members]), F.lit(lex.category_of[head])).otherwise(out)
    return out


def relevance(question: Column, held: Column, n_words: Column, weight: Column) -> Column:
    """Of a question's words, a document's words among those of all questions, and the number of the document's different words."""
    a = F.array_distinct(words(question))
    common = F.size(F.array_intersect(a, held))
    both = F.size(a) + n_words - common
    jaccard = F.when(both > 0, common / both).otherwise(F.lit(0.0))
    return F.round(F.least(weight * 10, F.lit(1.0)) * 0.7 + jaccard * 0.3, 3)


#: Pattern, question, category, keyword, confidence.
SPECIFIC_KO = (
    (r"\d+(?:,\d+)*(?:\.\d+)?", "구체적인 수치나 규모는 어떻게 되나요?", "구체정보", "수치", 0.8),
    (r"\d{4}년|\d{1,2}월|\d{1,2}일", "프로젝트 세부 일정은 어떻게 계획되어 있나요?", "일정", "날짜", 0.9),
    (r"필수|선택|권장|조건|기준", "필수 조건과 선택 조건을 구분해서 알려주세요", "요구사항", "조건", 0.85),
)
SPECIFIC_LATIN = ((r"\d+(?:,\d+)*(?:\.\d+)?", "which figures", "figures", "number", 0.8), (r"[Vv]ersion \d", "which version", "version", "version", 0.9), (r"[Ll]icense|[Rr]eleased", "which terms", "terms", "license", 0.85))


def specific_array(text: str, rules: tuple) -> Column:
    made = F.array(*[F.struct(F.lit(q).alias("question"), F.lit(c).alias("category"), F.lit(w).alias("keyword"), F.lit(s).alias("confidence"), F.regexp_count(text, F.lit(p)).cast("long").alias("frequency")) for p, q, c, w, s in rules])
    return F.filter(made, lambda x: x["frequency"] > 0)


def specific_questions(docs: DataFrame, rules: tuple = SPECIFIC_KO, key: str = "document_id", text: str = "content") -> DataFrame:
    """A question for each rule that a document matches, with the number of matches."""
    return docs.select(key, F.explode(specific_array(text, rules)).alias("q")).select(key, "q.*")


def recommended(docs: DataFrame, lex: Lexicon = KOREAN, rules: tuple = SPECIFIC_KO, top: int = 20) -> DataFrame:
    """The best questions for each document: its keywords' categories' questions by relevance, and the specific ones.

    Two scans: one counts keywords; one takes each text's words once and keeps those that a question has, the number of
    all, and the specific questions. No text is shuffled.
    """
    keyed = main_keywords(docs, lex).withColumn("category", category(F.col("word"), lex)).where("category is not null")
    best = keyed.groupBy("document_id", "category").agg(F.max(F.struct("weight", "word")).alias("_b")).select("document_id", "category", "_b.weight", F.col("_b.word").alias("keyword"))
    mine = best.groupBy("document_id").agg(F.collect_list(F.struct("category", "weight", "keyword")).alias("_best"))
    vocabulary = F.array_distinct(F.flatten(F.array(*[words(F.lit(q)) for qs in lex.templates.values() for q in qs])))
    seen = docs.select("document_id", F.array_distinct(words(F.col("content"))).alias("_w"), specific_array("content", rules).alias("_specific"))
    narrow = seen.select("document_id", F.array_intersect("_w", vocabulary).alias("_held"), F.size("_w").alias("_n"), "_specific")
    joined = narrow.join(mine, "document_id", "left")
    asked = F.create_map(*[x for c, qs in lex.templates.items() for x in (F.lit(c), strings(qs))])
    made = F.flatten(F.transform(F.coalesce("_best", F.array().cast("array<struct<category:string,weight:double,keyword:string>>")), lambda b: F.transform(F.coalesce(F.try_element_at(asked, b["category"]), strings([])), lambda q: F.struct(
        q.alias("question"), b["category"].alias("category"), b["keyword"].alias("keyword"), relevance(q, F.col("_held"), F.col("_n"), b["weight"]).alias("confidence"),
    ))))
    plain = F.transform("_specific", lambda x: F.struct(x["question"].alias("question"), x["category"].alias("category"), x["keyword"].alias("keyword"), x["confidence"].alias("confidence")))
    order = F.transform(F.concat(made, plain), lambda x: F.struct((-x["confidence"]).alias("c"), x["question"].alias("q"), x["category"].alias("k"), x.alias("x")))
    rows = joined.select("document_id", F.posexplode(F.slice(F.sort_array(order), 1, top)).alias("rank", "_o"))
    return rows.select("document_id", "_o.x.question", "_o.x.category", "_o.x.keyword", "_o.x.confidence", (F.col("rank") + 1).alias("rank"))


def better_questions(rows: DataFrame, lex: Lexicon = KOREAN, threshold: float = 0.5) -> DataFrame:
    """Hints where a question found little. rows: query_id, query, enhanced_query, detected_intent, n_sources, mean_score."""
    weak = F.col("mean_score") < threshold
    hints = F.array_compact(F.array(
        F.when(F.col("n_sources") == 0, F.lit("use more specific keywords")),
        F.when((F.col("n_sources") > 0) & weak & (F.col("detected_intent") == "general"), F.lit("ask a more specific question")),
        F.when((F.col("n_sources") > 0) & weak & (F.size(tokens(F.col("query"))) < 2), F.lit("add a related keyword")),
        F.when((F.col("n_sources") > 0) & weak & (F.col("enhanced_query") != F.col("query")), F.concat(F.lit("try: "), F.col("enhanced_query"))),
    ))
    return rows.select("query_id", F.array_join(hints, " / ").alias("hints"))


def two_pass(first: DataFrame, again, queries: DataFrame, least_confidence: float = 0.6, least_sources: int = 2) -> DataFrame:
    """first: answers of all questions; `again(queries)` answers the enhanced text, where it is another, of those that found little; the better one stays.

    queries: query_id, query, enhanced_query, qvec. The first pass is read twice, so callers have it written.
    """
    weak = first.where((F.col("confidence") < least_confidence) | (F.col("n_sources") < least_sources)).select("query_id")
    second = again(queries.where("enhanced_query <> query").join(weak, "query_id", "left_semi").withColumn("query", F.col("enhanced_query")))
    s = second.select("query_id", F.struct(*[c for c in second.columns if c != "query_id"]).alias("s"))
    f = first.select("query_id", F.struct(*[c for c in first.columns if c != "query_id"]).alias("f"))
    joined = f.join(s, "query_id", "left")
    better = F.coalesce(F.col("s.confidence") > F.col("f.confidence"), F.lit(False))
    return joined.withColumn("r", F.when(better, F.col("s")).otherwise(F.col("f"))).select("query_id", "r.*", better.alias("enhanced"), F.col("f.confidence").alias("first_confidence"), F.col("s.confidence").alias("second_confidence"))


def compare(original: DataFrame, enhanced: DataFrame, margin: float = 0.05) -> DataFrame:
    """Differences of confidence and sources, and a verdict."""
    o = original.select("query_id", F.col("confidence").alias("c0"), F.col("n_sources").alias("n0"))
    e = enhanced.select("query_id", F.col("confidence").alias("c1"), F.col("n_sources").alias("n1"))
    gain = F.round(F.col("c1") - F.col("c0"), 6)
    verdict = F.when(gain > margin, "better").when(gain < -margin, "worse").otherwise("same")
    return o.join(e, "query_id").select("query_id", gain.alias("confidence_gain"), (F.col("n1") - F.col("n0")).alias("sources_gain"), verdict.alias("verdict"))
