"""Headings of a text document as a tree of numbered nodes, and links of known names in a text."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import SparkSession, functions as F

_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", re.M)


def nodes(document: str, text: str) -> list[dict]:
    """id, parent, level, label, breadcrumb, own text (to the next heading) and full text (to the next of its level or above).

    Levels are made gapless: a heading is one deeper than the nearest shallower heading above it. Ids count siblings with
    two digits a level, under the document's name.
    """
    found = list(_HEADING.finditer(text))
    stack: list[tuple[int, str, str]] = []  # marks, id, label
    counts: dict[str, int] = {}
    out: list[dict] = []
    for k, m in enumerate(found):
        marks, label = len(m[1]), re.sub(r"\\([\\`*_{}\[\]()#+\-.!])", r"\1", m[2]).strip()
        while stack and stack[-1][0] >= marks:
            stack.pop()
        parent = stack[-1][1] if stack else document
        counts[parent] = counts.get(parent, 0) + 1
        own_id = f"{parent}-{counts[parent]:02d}"
        after = next((n.start() for n in found[k + 1 :] if len(n[1]) <= marks), len(text))
        own_end = found[k + 1].start() if k + 1 < len(found) else len(text)
        out.append({"id": own_id, "parent": parent if stack else None, "level": len(stack) + 1, "label": label, "breadcrumb": [s[2] for s in stack], "own": text[m.end() : own_end].strip(), "full": text[m.end() : after].strip()})
        stack.append((marks, own_id, label))
    return out


#: What tells a note on how a law was passed.
_PASSED = re.compile(r"通过|公布|发布|施行|修订|修正|批准")
_NUMBERED = re.compile(r"^[ \t]*([0-9]+(?:\.[0-9]+)*)[ \t\u3000]+(\S.{0,39})$")


def without_passing_note(text: str) -> str:
    """The text without the bracketed notes on when it was passed that stand between its title and its body."""
    lines, out, before = text.split("\n"), [], True
    for line in lines:
        bare = line.strip()
        if before and re.fullmatch(r"[（(].*[）)]", bare) and _PASSED.search(bare):
            continue
        before = before and (not bare or bare.startswith("#"))
        out.append(line)
    return "\n".join(out)


def numbered_headings(text: str, marks: int = 2) -> str:
    """Lines such as 3.2.1 Title as headings, with a mark for each number beyond ``marks`` - 1.

    A number counts only if it continues what is there: the next at its level, or the first below the last heading. So years,
    amounts and items of lists stay text.
    """
    seen: list[int] = []
    out = []
    for line in text.split("\n"):
        m = _NUMBERED.match(line)
        if m:
            own = [int(x) for x in m[1].split(".")]
            n = len(own)
            follows = own[:-1] == seen[: n - 1] and len(seen) >= n - 1 and own[-1] == (seen[n - 1] + 1 if len(seen) >= n else 1)
            if follows:
                seen = own
                out.append(f"{'#' * (marks + n - 1)} {m[1]} {m[2].strip()}")
                continue
        out.append(line)
    return "\n".join(out)


def lifted(found: list[dict]) -> list[dict]:
    """Nodes without a single top heading that only names the document: its children become the top, one level up."""
    tops = [n for n in found if n["level"] == 1]
    if len(tops) != 1 or tops[0]["own"] or len(found) < 2:
        return found
    top = tops[0]["id"]
    return [n | {"level": n["level"] - 1, "parent": None if n["parent"] == top else n["parent"], "breadcrumb": n["breadcrumb"][1:]} for n in found if n["id"] != top]


def law_nodes(law: str, text: str, suffix: str = "") -> list[dict]:
    """Nodes of a law's text: the outline without the passing notes, with key (law and article number, or None) and title."""
    from stemma.functions.cite import number

    out = []
    for n in lifted(nodes(law, without_passing_note(text))):
        m = re.match(r"第([0-9]+|[一二三四五六七八九十百千零]+)条", n["label"])
        out.append(n | {"key": f"{law}第{number(m[1])}条" if m and number(m[1]) else None, "title": n["label"] + (suffix if n["level"] == 1 else "")})
    return out


NODES = "array<struct<id:string,parent:string,level:int,label:string,breadcrumb:array<string>,own:string,full:string>>"


def nodes_udf():
    """(document, text) -> nodes."""

    @F.pandas_udf(NODES)
    def run(documents: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([nodes(d, t or "") for d, t in zip(documents, texts)])

    return run


#: What is no running text: images and links that are there already.
FORBIDDEN = re.compile(r"!\[[^\]]*\]\([^)]*\)|\[\[[^\]]*\]\]")


class Linker:
    """Links of known names in a text, by an automaton over the names and one pass over the intervals it finds.

    names: (surface, target); a surface of two targets is dropped. An interval counts if it meets no forbidden span; of those
    that begin at one place the longest counts. From the left, an interval is linked if it begins after the last link and its
    target isn't linked yet, nor the text's own.
    """

    def __init__(self, names: Iterable[tuple[str, str]]):
        import ahocorasick

        targets: dict[str, set[str]] = {}
        for surface, target in names:
            if surface := (surface or "").strip():
                targets.setdefault(surface, set()).add(target)
        self.automaton = ahocorasick.Automaton()
        for surface, own in targets.items():
            if len(own) == 1:
                self.automaton.add_word(surface, (len(surface), next(iter(own))))
        self.automaton.make_automaton()

    def intervals(self, text: str, forbidden: re.Pattern = FORBIDDEN) -> list[tuple[int, int, str]]:
        """start, end, target of the longest name at each place, outside forbidden spans."""
        if not len(self.automaton):
            return []
        closed = [m.span() for m in forbidden.finditer(text)]
        starts = [a for a, _ in closed]
        longest: dict[int, tuple[int, str]] = {}
        for last, (size, target) in self.automaton.iter(text):
            start, end = last - size + 1, last + 1
            k = bisect.bisect_left(starts, end) - 1  # the last span that begins before the end
            if (k < 0 or closed[k][1] <= start) and longest.get(start, (0, ""))[0] < end:
                longest[start] = end, target
        return [(a, *longest[a]) for a in sorted(longest)]

    def links(self, text: str, own: str | None = None, forbidden: re.Pattern = FORBIDDEN) -> list[tuple[int, str, str]]:
        """start, surface, target, from the left."""
        free, linked, out = 0, {own}, []
        for start, end, target in self.intervals(text, forbidden):
            if start >= free and target not in linked:
                linked.add(target)
                out.append((start, text[start:end], target))
                free = end
        return out


def links_udf(spark: SparkSession, names: list[tuple[str, str]]):
    """(text, own target) -> links; the names are a lexicon that the driver holds, broadcast once and built once a task."""
    shared = spark.sparkContext.broadcast(names)

    @F.pandas_udf("array<struct<at:int,surface:string,target:string>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        linker = Linker(shared.value)
        for texts, own in batches:
            yield pd.Series([[{"at": a, "surface": s, "target": t} for a, s, t in linker.links(x or "", o)] for x, o in zip(texts, own)])

    return run
