"""Citations of articles in running text: named law, article, clause and item, with lists and ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

_NUMBER = "[0-9]+|[零〇一二三四五六七八九十百千]+"
_ARTICLE = re.compile(rf"第({_NUMBER})条(?:之({_NUMBER}))?")
_CLAUSE, _ITEM = re.compile(rf"第({_NUMBER})款"), re.compile(rf"第[（(]?({_NUMBER})[)）]?项")
_LIST, _RANGE = re.compile(r"\s*(?:、|，|,|和|及|与|或者|或|以及)\s*"), re.compile(r"\s*(?:至|到|～|~|—+|-)\s*")
#: What may stand between a law's name and its article, closest last.
_DECORATION = re.compile(r"(?:\s|》|〉|”|（[^（）\n]{0,40}）|\([^()\n]{0,40}\))+$")
#: Names that make rules named after them foreign ones, the alias for which that is looked at, and words for the
#: text's own law.
TREATY = ("条约", "公约", "议定书")
LEGACY = "实施细则"
SELF = ("本法", "本条例", "本办法", "本细则", "本规定", "本规则", "本解释", "本标准", "本规程", "本纲要", "本指引")
#: Longest range that is spelt out; of longer ones only the ends count.
SPELT = 60


def number(text: str) -> int | None:
    """Value of a Chinese or Arabic numeral; None for zero and what isn't one."""
    if text.isascii():
        return int(text) or None if text.isdigit() else None
    total, digit = 0, 0
    for c in text:
        if c in "十百千":
            total += (digit or 1) * {"十": 10, "百": 100, "千": 1000}[c]
            digit = 0
        elif (digit := "零一二三四五六七八九".find(c)) < 0:
            return None
    return total + digit or None


@dataclass(frozen=True)
class Citation:
    law: str
    article: int
    branch: int | None
    clause: int | None
    item: int | None
    position: int
    raw: str

    @property
    def key(self) -> str:
        return f"{self.law}第{self.article}条" + (f"之{self.branch}" if self.branch else "") + (f"第{self.clause}款" if self.clause else "") + (f"第{self.item}项" if self.item else "")


class Extractor:
    """laws: name or alias -> canonical name; own: the law that the text itself is, for self-references."""

    def __init__(self, laws: dict[str, str], own: str | None = None):
        self.aliases = sorted(laws, key=len, reverse=True)
        self.laws, self.own = laws, own
        self.window = max(map(len, laws), default=0) + 20

    def named(self, text: str, end: int) -> str | None:
        """The law whose name, decorations aside, ends where an article begins."""
        left = text[max(0, end - self.window) : end]
        left = left[left.rfind("\n\n") + 2 :] if "\n\n" in left else left
        left = _DECORATION.sub("", left)
        undated = re.sub(r"[0-9]{2,4}$", "", left)
        for alias in self.aliases:
            for form in dict.fromkeys((left, undated)):
                if form.endswith(alias) and not (alias == LEGACY and form.removesuffix(alias).endswith(TREATY)):
                    return self.laws[alias]
        return self.own if left.endswith(SELF) else None

    def __call__(self, text: str) -> Iterator[Citation]:
        law, at, article, clause, item = None, -1, None, None, None
        position = 0
        while position < len(text):
            m = _ARTICLE.search(text, position)
            here = None
            if law:  # a list or range that goes on from the last citation
                join = _LIST.match(text, at) or _RANGE.match(text, at)
                if join:
                    ranged = bool(_RANGE.match(text, at))
                    for level, pattern in (("article", _ARTICLE), ("clause", _CLAUSE), ("item", _ITEM)):
                        k = pattern.match(text, join.end())
                        if k and (level == "article" or level == "clause" and clause or level == "item" and item):
                            here = (level, k, ranged)
                            break
            if here:
                level, k, ranged = here
                value = number(k[1])
                if value is None:
                    law = None
                    position = k.end()
                    continue
                last = {"article": article, "clause": clause, "item": item}[level]
                values = range(last + 1, value + 1) if ranged and last and 0 < value - last <= SPELT else [value]
                start = at
                if level == "article":
                    clause, item, end, clause_, item_ = *(None, None), *self._below(text, k.end())
                else:
                    end, clause_, item_ = k.end(), clause, item
                for v in values:
                    article, clause, item = (v, None, None) if level == "article" else (article, v, None) if level == "clause" else (article, clause, v)
                    if v == values[-1] and level == "article":
                        clause, item = clause_, item_
                    yield Citation(law, article, number(k[2]) if level == "article" and k[2] else None, clause, item, start, text[start:end])
                at = position = end
                continue
            if not m:
                return
            law, article = self.named(text, m.start()), number(m[1])
            if law and article:
                end, clause, item = self._below(text, m.end())
                yield Citation(law, article, number(m[2]) if m[2] else None, clause, item, m.start(), text[m.start() : end])
                at = position = end
            else:
                law, position = None, m.end()

    @staticmethod
    def _below(text: str, at: int) -> tuple[int, int | None, int | None]:
        clause = item = None
        if m := _CLAUSE.match(text, at):
            clause, at = number(m[1]), m.end()
        if m := _ITEM.match(text, at):
            item, at = number(m[1]), m.end()
        return at, clause, item


SCHEMA = "array<struct<key:string,law:string,article:int,clause:int,item:int,position:int,raw:string>>"


def citations_udf(laws: dict[str, str], own: str | None = None):
    """Column of text -> array of its citations in order; the laws are a list that the driver holds, read once a task."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extract = Extractor(laws, own)
        for texts in batches:
            yield texts.map(lambda t: [{"key": c.key, "law": c.law, "article": c.article, "clause": c.clause, "item": c.item, "position": c.position, "raw": c.raw} for c in extract(t or "")])

    return run
