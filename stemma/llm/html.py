"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page's token stream is balanced to nested elements and aligned with its host's wrapper so far. Equal text stays constant
and unequal text becomes a slot; neighbouring runs of the same element, or of up to three elements in turn, become a
repeated group; what only one side has becomes optional. Where an element's children come in ever new orders, they become
one repeated group of optional children, and where their names are ever new, elements that differ in nothing else count as
one; so a wrapper's size is bounded by the element names and not by the pages. These rules make a wrapper more general, never
less: each page of the host still matches it.

A page is then matched against its host's wrapper, and its text is taken from the slots. The part that a slot belongs to is
that of the innermost element around it that says so: the article, the main part, or else the body; slots in menus, headers,
footers, sidebars, notices, adverts, forms, comments and the like belong to none. In the body, where no element names the main
text, the wrapper tells it from what the site repeats: a text that is constant and stands on at least half of the host's
different pages, or a repeated group whose slots are all texts of links, is page furniture if anything else is left. The
text is what stands in the article's slots, or else in those of the main part, or else in those of the body, by block.

Scale: wrappers are merged within each task first, then by host and salt, then by host; a host with a third of the pages
sends a few kilobytes from each task. Wrappers are broadcast if measured below ``BROADCAST`` bytes, else joined by host.

Defined cases: null, empty and textless pages have an empty text; a url without "://" belongs to the empty host; broken
markup is read as far as it is markup, a tag that never ends ends the page; elements left open end with their parents; nesting
and tags have any depth and length; repeated rows are returned each, and count once for what pages have in common.
"""

from __future__ import annotations

import hashlib
import html as _entities
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stemma.llm._spark import batch_of, cut_columnar

#: Digests of different pages that a wrapper node remembers, and the least of them that tell what a site repeats.
SEEN, SITE = 16, 5
BROADCAST = 32 << 20
#: Children of one element before they become one repeated group, and hosts that a task holds before it passes them on.
WIDE, HOSTS = 48, 2000
#: Levels of a wrapper; what is nested deeper is matched by the last of them. Parts are known at any depth.
DEEP = 100

# Element names by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html caption dd dt li option legend tbody td tfoot th thead tr".split())
_P_SCOPE = frozenset("button td th caption table".split())
_SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "body": ("head", "html")}
SIBLINGS = {k: (tuple(same.split()), frozenset(within.split())) for k, (same, within) in _SIBLINGS.items()}
DROPPED = frozenset("head nav footer aside form script style textarea title noscript iframe button select option dialog menu template svg math object audio video canvas input label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Parts of class and id names.
NAMED = "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended breadcrumb breadcrumbs pagination pager comment comments disqus respond reply replies widget toolbar copyright login search".split()
#: With these beginnings or ends a name means the same without a hyphen.
BEGINNINGS = "comment cookie advert sidebar navbar navigation newsletter breadcrumb sponsor popup disqus footer masthead subscri pagination adsby".split()
ENDINGS = "nav menu sidebar footer banner comments".split()
_NAMED = re.compile(r"(?:^|[-_])(?:" + "|".join(NAMED) + r")s?(?:$|[-_0-9])|(?:^|[-_])(?:" + "|".join(BEGINNINGS) + r")|(?:" + "|".join(ENDINGS) + r")(?:$|[-_0-9])")
_COMMENT = re.compile(r"(?:^|[-_])(?:comment|repl(?:y|ies)(?:$|[-_0-9])|disqus)")

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?])")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _name(part: str) -> str:
    """A class or id name; pieces with digits in them are numbers or codes of one page and don't count."""
    return re.sub(r"[^-_]*[0-9][^-_]*", "0", part)


def _key(name: str, attributes: str) -> str:
    """The element's name with its class, id and role."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    names = sorted({_name(x) for k in ("class", "id") for x in found.get(k, "").lower().replace("/", " ").split()})
    role = found.get("role", "").lower().strip().replace("/", " ")
    return name + "".join(f".{x}" for x in names) + (f"@{role}" if role else "")


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """("text", text, "", end), ("open", name, attributes, end) and ("close", name, "", end); send a place to go on from there."""
    at, n = 0, len(page)
    absent: set[str] = set()  # quotes of which there are no more

    def tag_end(i: int) -> int:
        """Of the tag whose attributes begin at i: the place of its >, or -1. A quote after = holds all up to the next."""
        while m := _STOP.search(page, i):
            i = m.end()
            if m[0] == ">":
                return m.start()
            before = m.start() - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and m[0] not in absent:
                close = page.find(m[0], i)
                if close < 0:
                    absent.add(m[0])
                else:
                    i = close + 1
        return -1

    begin = 0
    while at < n:
        m = _TAG.search(page, at)
        start = m.start() if m else n
        if m and m[2] is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                end = n if end < 0 else end + 3
            else:
                end = page.find(">", start)
                end = n if end < 0 else end + 1
        elif m:
            close = tag_end(m.end())
            end = n if close < 0 else close + 1
        else:
            end = n
        if start > begin:
            yield "text", page[begin:start], "", start
        if not m:
            return
        at = begin = end
        if m[2] is not None and close >= 0:
            go = yield ("close" if m[1] else "open"), m[2].lower(), page[m.end() : close], end
            if go is not None:
                at = begin = go


def events(page: str) -> Iterator[tuple[str, str]]:
    """("open", key), ("close", name), ("text", decoded text) and ("break", "") of a page, balanced."""
    stack: list[str] = []
    many: dict[str, int] = {}  # open elements of a name

    def pop_to(i: int) -> Iterator[tuple[str, str]]:
        while len(stack) > i:
            name = stack.pop()
            many[name] -= 1
            yield "close", name

    def last(names: tuple[str, ...], until: frozenset = frozenset()) -> int:
        if any(many.get(x) for x in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in names:
                    return i
                if stack[i] in until:
                    break
        return -1

    stream = tokens(page)
    lower = None
    token = next(stream, None)
    while token is not None:
        kind, value, attributes, end = token
        go = None
        if kind == "text":
            yield "text", _entities.unescape(value)
        elif kind == "close":
            i = last((value,))
            if i >= 0:
                yield from pop_to(i)
            elif value == "br":
                yield "break", ""
        else:
            if value in ENDS_P and (i := last(("p",), _P_SCOPE)) >= 0:
                yield from pop_to(i)
            if value in SIBLINGS:
                same, within = SIBLINGS[value]
                while (i := last(same, within)) >= 0:
                    yield from pop_to(i)
            yield "open", _key(value, attributes)
            if value in VOID or attributes.endswith("/") and value in ("svg", "math"):
                yield "close", value
            elif value in RAW:
                lower = lower if lower is not None else page.lower()
                close = lower.find(f"</{value}", end)
                close = page.find(">", close) if close >= 0 else -1
                go = len(page) if close < 0 else close + 1
                yield "close", value
            else:
                stack.append(value)
                many[value] = many.get(value, 0) + 1
        try:
            token = stream.send(go)
        except StopIteration:
            break
    yield from pop_to(0)


# A wrapper node is [key, repeated, optional, constant text or None, pages, children]; text nodes have the key "#". Of long
# texts the constant is the beginning and a digest of the whole; pages are the lowest SEEN digests of the different pages.
Node = list


def _digest(text: str, size: int) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).hexdigest()


def tree(page: str) -> Node:
    pages = [_digest(page, 8)]
    root: Node = ["", False, False, None, pages, []]
    path, deeper = [root], 0
    for kind, value in events(page):
        if kind == "open":
            if deeper or len(path) > DEEP:
                deeper += 1
                continue
            node = [value, False, False, None, [], []]
            path[-1][5].append(node)
            path.append(node)
        elif kind == "close":
            if deeper:
                deeper -= 1
            else:
                path.pop()
        elif kind == "text" and not value.isspace():
            own = path[-1][5]
            text = " ".join(value.split())
            if own and own[-1][0] == "#":
                own[-1][5].append(text)
            else:
                own.append(["#", False, False, None, pages, [text]])
    return _folded(root)


def _folded(node: Node) -> Node:
    if node[0] == "#":
        text = " ".join(node[5])
        return [*node[:3], text if len(text) <= 120 else f"{text[:80]} {_digest(text, 16)}", node[4], []]
    node[5] = fold([_folded(c) for c in node[5]])
    return node


def merge(a: Node, b: Node, repeated: bool = False) -> Node:
    """Of nodes with one key; repeated: they are of the same page."""
    return [a[0], a[1] or b[1] or repeated, a[2] or b[2], a[3] if a[3] == b[3] else None, a[4] if a[4] == b[4] else sorted({*a[4], *b[4]})[:SEEN], align(a[5], b[5])]


def fold(nodes: list[Node]) -> list[Node]:
    """Neighbouring runs of one to three keys in turn as repeated nodes."""
    for period in (1, 2, 3):
        out: list[Node] = []
        for node in nodes:
            out.append(node)
            tail = out[-2 * period :]
            if len(tail) == 2 * period and all(x[0] == y[0] for x, y in zip(tail, tail[period:])) and (period == 1 or len({x[0] for x in tail}) > 1):
                out[-2 * period :] = [merge(x, y, True) for x, y in zip(tail, tail[period:])]
        nodes = out
    return nodes


def general(key: str) -> str:
    """An element of any names, if these say nothing of its part."""
    name = re.split(r"[.@]", key, maxsplit=1)[0]
    return f"{name}.*" if key not in ("#", name) and _part(key, False) == _part(name, False) else key


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One list for both: equal keys in order are merged, the others are optional."""
    ka, kb = [n[0] for n in a], [n[0] for n in b]
    if ka == kb:
        return [merge(x, y) for x, y in zip(a, b)]
    out: list[Node] = []
    for what, i, j, k, m in SequenceMatcher(None, ka, kb, False).get_opcodes():
        if what == "equal":
            out += [merge(x, y) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [[n[0], n[1], True, *n[3:]] for n in (*a[i:j], *b[k:m])]
    out = fold(out)
    for name in (lambda k: k, general):
        if len(out) > WIDE:
            by_key: dict[str, Node] = {}
            for n in out:
                n = [name(n[0]), *n[1:]]
                by_key[n[0]] = merge(by_key[n[0]], n, True) if n[0] in by_key else n
            out = [[n[0], True, True, *n[3:]] for n in by_key.values()]
    return out


def expression(nodes: list[Node]) -> str:
    """The wrapper as a regular expression over tags, constants and slots."""
    out = []
    for key, repeated, optional, constant, _, children in nodes:
        own = (json.dumps(constant, ensure_ascii=False) if constant is not None else "#TEXT") if key == "#" else f"<{key}>{expression(children)}</>"
        out.append(f"({own}){'+' * repeated}{'?' * optional}" if repeated or optional else own)
    return "".join(out)


def _part(key: str, inside_article: bool) -> int:
    """-1: nothing in it is main text; 2, 1: it is the article, the main part; 0: neither."""
    name, _, role = key.partition("@")
    name, *names = name.split(".")
    if name in DROPPED or role in ROLES or name == "header" and not inside_article:
        return -1
    if name in ("html", "body"):
        return 0
    if any(_COMMENT.search(x) for x in names):
        return -1
    if name in ("article", "main") or role in ("article", "main"):
        return 2 if "article" in (name, role) else 1
    return -1 if any(_NAMED.search(x) and not x.startswith(("with-", "has-", "no-", "without-")) and "with-" not in x for x in names) else 0


#: What is known at an element: its part, whether it is in a header, and in a heading.
State = tuple[int, bool, bool]
BODY: State = (0, False, False)


def within(state: State, key: str) -> State:
    part, header, heading = state
    if part < 0:
        return state
    own = _part(key, part == 2)
    name = re.split(r"[.@]", key, maxsplit=1)[0]
    return (-1 if own < 0 else max(part, own), header or name == "header", heading or re.fullmatch("h[1-6]", name) is not None)


def part_of(state: State) -> int:
    """Of a slot; of an article's header, only headings belong to it."""
    return -1 if state[1] and not state[2] else state[0]


class Wrapper:
    """A wrapper node to match pages against."""

    __slots__ = ("children", "places", "repeats", "furniture")

    def __init__(self, node: Node, site: list[str]):
        self.children: list[Wrapper] = []
        self.places: dict[str, list[int]] = {}
        self.repeats: list[bool] = []
        self.furniture = node[0] == "#" and node[3] is not None and len(site) >= SITE and 2 * len({*site} & {*node[4]}) >= len(site)
        for i, child in enumerate(node[5]):
            key = child[0]
            own = Wrapper(child, site)
            if child[1] and _linked(child):
                own.mark()
            self.children.append(own)
            self.places.setdefault(key, []).append(i)
            self.repeats.append(child[1])

    def mark(self) -> None:
        self.furniture = True
        for c in self.children:
            c.mark()

    def place(self, key: str, after: int) -> int:
        """The child that an element is matched with, -1 if there is none; after: the one matched before."""
        found = self.places.get(key) or self.places.get(general(key))
        if not found:
            return -1
        if after in found and self.repeats[after]:
            return after
        return next((i for i in found if i > after), found[0])  # a repeated group begins anew


def _linked(node: Node, in_link: bool = False) -> bool:
    """Whether all texts in it are texts of links, and there are some."""
    inside = in_link or node[0].split(".")[0] == "a"
    texts = [inside if c[0] == "#" else _linked(c, inside) for c in node[5] if c[0] == "#" or _texts(c)]
    return bool(texts) and all(texts)


def _texts(node: Node) -> bool:
    return any(c[0] == "#" or _texts(c) for c in node[5])


def compiled(node: Node) -> Wrapper:
    return Wrapper(node, node[4])


def extract(page: str, wrapper: Wrapper | None) -> str:
    """Text in the page's slots of the part that says most, a line for each block."""
    blocks: list[tuple[int, str]] = []  # part, -1 for furniture of the body; text
    block: list[str] = []
    own_part = -2
    #: Wrapper node (None where the wrapper ends), its last matched child, whether that is a text that goes on, state.
    path: list[list] = [[wrapper, -1, False, BODY]]

    def close() -> None:
        nonlocal block
        text = " ".join("".join(block).split())
        if text:
            blocks.append((own_part, text))
        block = []

    for kind, value in events(page):
        top = path[-1]
        if kind == "open":
            name = re.split(r"[.@]", value, maxsplit=1)[0]
            if name in BLOCK:
                close()
            elif name == "br":
                block.append(" ")
            node, state = top[0], top[3]
            if node is not None and len(path) <= DEEP:
                i = node.place(value, top[1])
                top[1], top[2] = (i if i >= 0 else top[1]), False
                path.append([node.children[i] if i >= 0 else None, -1, False, within(state, value)])
            else:
                path.append([node, top[1], top[2], within(state, value)])
        elif kind == "close":
            if value in BLOCK:
                close()
            path.pop()
        elif kind == "break":
            block.append(" ")
        else:
            part = part_of(top[3])
            blank = value.isspace()
            node = top[0]
            furniture = False
            if node is not None and not blank:
                if not top[2]:
                    i = node.place("#", top[1])
                    top[1], top[2] = (i if i >= 0 else top[1]), i >= 0
                furniture = top[2] and node.children[top[1]].furniture
            if part < 0:
                if block and blank:
                    block.append(" ")
                continue
            if part == 0 and not blank:
                part = -1 if furniture else 0
            if block and part != own_part and not blank:
                close()
            if not blank:
                own_part = part
            if block or not blank:
                block.append(value)
    close()
    best = max((p for p, _ in blocks), default=0)
    return "\n".join(t for p, t in blocks if p == best)


def _host(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""


_WRAPPED = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())])
_WRAPPED_SQL = "host string, salt int, wrapper string"


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Node] = {}

    def out() -> pa.RecordBatch:
        salt = zlib.crc32("\n".join(sorted(held)).encode()) % 64
        return batch_of(_WRAPPED, {"host": list(held), "salt": [salt] * len(held), "wrapper": [json.dumps(w) for w in held.values()]})

    for batch in batches:
        for url, page in zip(*batch.columns, strict=True):
            host, own = _host(url.as_py()), tree(page.as_py() or "")
            held[host] = merge(held[host], own) if host in held else own
            if len(held) > HOSTS:
                yield out()
                held = {}
    yield out()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host: one row a host."""
    host, held = None, None
    for batch in batches:
        done: dict[str, list] = {"host": [], "salt": [], "wrapper": []}
        for own_host, _, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = json.loads(wrapper)
            if own_host == host:
                held = merge(held, own)
                continue
            if held is not None:
                done["host"].append(host)
                done["salt"].append(0)
                done["wrapper"].append(json.dumps(held))
            host, held = own_host, own
        yield batch_of(_WRAPPED, done)
    if held is not None:
        yield batch_of(_WRAPPED, {"host": [host], "salt": [0], "wrapper": [json.dumps(held)]})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper of every host. pages: url, html."""
    parts = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_infer, _WRAPPED_SQL)
    some = parts.repartition("host", "salt").sortWithinPartitions("host", "salt").mapInArrow(_merge, _WRAPPED_SQL)
    return some.repartition("host").sortWithinPartitions("host").mapInArrow(_merge, _WRAPPED_SQL).select("host", "wrapper")


_MAIN = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
_MAIN_SQL = "page_id long, url string, text string, n_chars long"


def _extracted(batch: pa.RecordBatch, known: list[Wrapper | None]) -> pa.RecordBatch:
    text = [extract(h or "", k) for h, k in zip(batch.column(2).to_pylist(), known)]
    return batch_of(_MAIN, {"page_id": batch.column(0), "url": batch.column(1), "text": text, "n_chars": [len(t) for t in text]})


class _Compiled(dict):
    """Wrappers that a task has read, by their JSON; it forgets them when there are too many."""

    def __missing__(self, text: str | None) -> Wrapper | None:
        if len(self) >= HOSTS:
            self.clear()
        self[text] = out = compiled(json.loads(text)) if text else None
        return out


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars for every row. pages: page_id, url, html; other columns are ignored."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = cut_columnar(wrappers(own))
    size = found.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    if size <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = _Compiled()
            for batch in batches:
                yield _extracted(batch, [read[shared.value.get(_host(url))] for url in batch.column(1).to_pylist()])

        return own.mapInArrow(run, _MAIN_SQL)
    host = F.coalesce(F.translate(F.regexp_extract("url", r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Compiled()
        for batch in batches:
            yield _extracted(batch, [read[w] for w in batch.column(3).to_pylist()])

    return own.withColumn("host", host).join(found, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(joined, _MAIN_SQL)
