"""Column functions on text: tokens, stripping, cleaning, quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of the value, which is computed once however often and in whatever lambda the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def terms(c: Column) -> Column:
    """White-space separated tokens in lower case."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def is_meaningful(c: Column, least: int = 100, hangul: int = 20, latin: int = 50) -> Column:
    """Enough characters, and enough Hangul syllables or ASCII letters among them."""
    t = F.coalesce(c, F.lit(""))
    return (F.length(strip(t)) >= least) & ((F.regexp_count(t, F.lit("[가-힣]")) > hangul) | (F.regexp_count(t, F.lit("[A-Za-z]")) > latin))


def is_meaningful_fragment(c: Column, least: int = 10) -> Column:
    return (F.length(strip(F.coalesce(c, F.lit("")))) >= least) & F.coalesce(c, F.lit("")).rlike(r"\p{L}")


def clean(c: Column, squeeze_runs: bool = True) -> Column:
    """Drops control characters, squeezes spaces, three line ends or more to two, runs of one character over ten (line ends aside) to one, and strips."""
    t = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    t = F.regexp_replace(t, r" +", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    if squeeze_runs:
        t = F.regexp_replace(t, r"(?d)(.)\1{10,}", "$1")
    return strip(t)


def first_meaningful(candidates: list[tuple[str, Column]], fallback: Column, fallback_method: str = "filename_only") -> tuple[Column, Column]:
    """(text, method): the first candidate that passes the gate, else the fallback."""
    text, method = fallback, F.lit(fallback_method)
    for name, c in reversed(candidates):
        ok = is_meaningful(c)
        text, method = F.when(ok, c).otherwise(text), F.when(ok, F.lit(name)).otherwise(method)
    return text, method


#: Entities that HTML text is decoded from, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_title(c: Column) -> Column:
    return decode_entities(strip(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def decode_entities(c: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def html_to_text(c: Column) -> Column:
    """The body's text without script, style, navigation and comments; tags become spaces."""
    for tag in ("head", "script", "style", "nav"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return strip(F.regexp_replace(decode_entities(c), r"\s+", " "))


def cascade(c: Column, patterns: list[str], valid=None, prefix: int | None = None, group: int = 1) -> Column:
    """The first pattern's first match that is valid."""
    t = c if prefix is None else F.substring(c, 1, prefix)
    found = []
    for p in patterns:
        m = first_match(t, p, group)
        found.append(m if valid is None else F.when(valid(m), m))
    return F.coalesce(*found)


def pattern_votes(c: Column, groups: dict[str, list[str]], default: str, prefix: int | None = None) -> Column:
    """The group whose patterns match most often in the text in lower case, whatever their own; the earlier one among equals; the default where none matches."""
    t = F.lower(c if prefix is None else F.substring(c, 1, prefix))
    scored = [
        F.struct(reduce(lambda a, b: a + b, [F.regexp_count(t, F.lit(f"(?iU){p}")) for p in patterns]).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (name, patterns) in enumerate(groups.items())
    ]
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, best["name"]).otherwise(F.lit(default))
