"""Metadata from texts by cascades of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import cascade, first_match, pattern_votes, strip


def agency_of_name(name: Column) -> Column:
    """The file name's part before the first underscore, if longer than one character and not all digits."""
    head = F.split_part(name, F.lit("_"), F.lit(1))
    return F.when(name.contains("_") & (F.length(head) > 1) & ~head.rlike(r"^\d+$"), head)


def agency(text: Column, patterns: list[str] = L.AGENCY_KO, prefix: int | None = 2000) -> Column:
    """The first pattern's first match, whatever its case, that is longer than one character and no number; of it the word characters, blanks and round brackets."""
    valid = lambda m: (F.length(strip(m)) > 1) & ~strip(m).rlike(r"^\p{Nd}+$")
    found = strip(cascade(text, [f"(?iU){p}" for p in patterns], valid, prefix))
    return F.nullif(strip(F.regexp_replace(found, r"[^\p{L}\p{N}_\s()（）]", "")), F.lit(""))


def business_type(text: Column, name: Column, groups: dict[str, list[str]] = L.BUSINESS_KO, prefix: int | None = 3000) -> Column:
    body = text if prefix is None else F.substring(text, 1, prefix)
    return pattern_votes(F.concat_ws(" ", body, name), groups, L.BUSINESS_DEFAULT)


def budget(text: Column, patterns: list[str] = L.BUDGET_KO, prefix: int | None = 5000, least: int = 1000) -> tuple[Column, Column]:
    """(text, amount): the first pattern whose first match is a number over `least`; the amount scales units of 억 and 천만."""
    digits = lambda m: F.when(F.replace(m, F.lit(","), F.lit("")).rlike(r"^\d{1,18}$"), F.replace(m, F.lit(","), F.lit("")).cast("bigint"))
    found = digits(cascade(text, patterns, lambda m: F.coalesce(digits(m) > least, F.lit(False)), prefix))
    body = text if prefix is None else F.substring(text, 1, prefix)
    scaled = F.coalesce(digits(first_match(body, r"([0-9,]+)\s*억\s*원")) * 100_000_000, digits(first_match(body, r"([0-9,]+)\s*천만\s*원")) * 10_000_000)
    return F.when(found.isNotNull(), F.concat(found.cast("string"), F.lit("원"))), F.coalesce(found, scaled)


def deadline(text: Column, patterns: list[str] = L.DEADLINE_KO, until: str = L.DEADLINE_UNTIL_KO, prefix: int | None = 3000) -> tuple[Column, Column]:
    """(text, date): signs for year, month and day become hyphens; the pattern of three groups is padded."""
    body = text if prefix is None else F.substring(text, 1, prefix)
    one = F.regexp_replace(F.regexp_replace(cascade(body, patterns), r"[년월일]", "-"), r"-+", "-")
    one = F.regexp_replace(one, r"^-+|-+$", "")
    y, m, d = (first_match(body, until, g) for g in (1, 2, 3))
    three = F.concat_ws("-", F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    out = F.coalesce(one, F.when(y.isNotNull(), three))
    return out, F.try_to_date(F.replace(out, F.lit("."), F.lit("-")), "yyyy-M-d")


def notice_fields(docs: DataFrame, text: str = "content", fields: tuple = L.NOTICE_KO) -> DataFrame:
    """Adds the second pattern set's columns, each the first pattern's first match; whole matches as they are, groups stripped."""
    found = lambda group, patterns: F.coalesce(*[first_match(F.col(text), p, group) for p in patterns])
    return docs.withColumns({name: strip(found(group, patterns)) if group else found(group, patterns) for name, group, patterns in fields})


def merge(*maps: Column) -> Column:
    """Maps merged, the last one wins."""
    entries = F.concat(*[F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))) for m in maps])
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))
