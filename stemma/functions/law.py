"""Normalisers and query parsing for laws, statuses, dates and versions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from stemma.functions import text as T
from stemma.functions.cite import number

#: How a status begins, and its code.
STATUS = (("现行", "in_force"), ("有效", "in_force"), ("尚未", "not_yet"), ("未生效", "not_yet"), ("废止", "repealed"), ("已废止", "repealed"), ("失效", "repealed"), ("已被", "repealed"), ("部分", "partial"), ("征求意见", "draft"))
#: A bracket at the end of a status from this length on is a note of its own.
NOTE = 40


def status_code(status: Column) -> Column:
    out = F.lit("unknown")
    for prefix, code in reversed(STATUS):
        out = F.when(F.trim(status).startswith(prefix), code).otherwise(out)
    return F.when(T.either(F.trim(status), F.lit("")) == "", F.lit(None).cast("string")).otherwise(out)


def status_note(status: Column) -> tuple[Column, Column]:
    """The status without a long bracket at its end, and that bracket's text."""
    inner = F.regexp_extract(status, r"（([^（）]*)）\s*$", 1)
    long = F.length(inner) >= NOTE
    return F.when(long, F.trim(F.regexp_replace(status, r"（[^（）]*）\s*$", ""))).otherwise(status), F.when(long, inner)


def title_suffix(title: Column, effective: Column, issued: Column) -> Column:
    """Nothing for a title with a year; else the year it took effect, else the year it was issued, else nothing."""
    return F.when(T.first_year(title).isNotNull(), "").when(T.first_year(effective).isNotNull(), F.concat(F.lit("（"), T.first_year(effective), F.lit("年施行）"))).when(T.first_year(issued).isNotNull(), F.concat(F.lit("（"), T.first_year(issued), F.lit("年发布）"))).otherwise("")


def efficacy(fields: dict[str, Column]) -> Column:
    """Rows (label, value) in the given order, without empty values."""
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.coalesce(F.trim(v), F.lit("")).alias("value")) for k, v in fields.items()])
    return F.filter(rows, lambda r: r.value != "")


def article_title(label: Column) -> Column:
    """What follows the first " · " of an article's label, else nothing."""
    at = F.instr(label, " · ")
    return F.when(at > 0, F.trim(F.substring(label, at + 3, F.length(label)))).otherwise("")


def version_key(version: Column) -> Column:
    """Numeric parts of a version with or without v; missing parts are zero, pre-releases sort before their release."""
    bare = F.regexp_replace(F.trim(version), "^[vV]", "")
    parts = F.transform(F.split(F.substring_index(bare, "-", 1), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)
    return F.struct(padded.alias("parts"), (~F.contains(bare, F.lit("-"))).alias("release"))


@dataclass(frozen=True)
class ArticleQuery:
    law: str | None
    article: int
    explicit: bool  # the query names the law
    missing: bool  # the law has no such article


_ARTICLE = re.compile(r"第?\s*([0-9]+|[一二三四五六七八九十百千零]+)\s*条")
_DROPPED = re.compile(r"[\s《》〈〉“”\"'（）()·,，、。.]")


def normal_name(text: str) -> str:
    return _DROPPED.sub("", text).lower()


def parse_article_query(query: str, laws: dict[str, str], articles: dict[str, int], default: str | None = None) -> ArticleQuery | None:
    """A named law's article; None if the name is unknown; for a bare number the default law, as a weak reading.

    laws: alias -> law; articles: law -> number of articles.
    """
    m = _ARTICLE.search(query)
    value = number(m[1]) if m else None
    if value is None:
        return None
    left = normal_name(query[: m.start()])
    named = max((a for a in laws if left.endswith(normal_name(a)) and normal_name(a)), key=lambda a: len(normal_name(a)), default=None)
    if named:
        law = laws[named]
        return ArticleQuery(law, value, True, value > articles.get(law, 0))
    if re.search(r"[法例则定约]$", left) or not default:
        return None
    return ArticleQuery(default, value, False, value > articles.get(default, 0))
