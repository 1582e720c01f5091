"""Each operator against a brute-force form and on the cases that its docstring defines."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stemma.llm import _text, decontaminate, hmm, hosts, html, licenses, neardup, packing, quality, toxicity, warc
from stemma.llm.queries import RULES, fold, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, kept_text string"
ALNUM, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs_of(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \n\t", "one", "ÄÖ é 中文", "a\x00b", "x" * 5000, "\n".join(["same line here"] * 30)]


@pytest.mark.parametrize("segment", [1 << 20, 16])
def test_words_match_the_patterns(segment, monkeypatch):
    monkeypatch.setattr(_text, "SEGMENT", segment)
    r = random.Random(1)
    texts = [*ODD, *("".join(r.choice("aB 1é-\n") for _ in range(r.randint(0, 60))) for _ in range(200))]
    for table, pattern, lower in ((_text.ALNUM, ALNUM, True), (_text.SPACED, SPACED, False), (_text.SPACED_LOWER, SPACED, True)):
        h, _, _, ranges = _text.words(*_text.buffers(pa.array(texts)), table)
        known = {}
        for i, t in enumerate(texts):
            own = pattern.findall(low(t) if lower else t or "")
            assert len(own) == ranges[i + 1] - ranges[i]
            for w, x in zip(own, h[ranges[i] : ranges[i + 1]].tolist()):
                assert known.setdefault(w, x) == x
        assert len(set(known.values())) == len(known)


def test_cut_tables_stay_until_cleared(spark):
    from stemma.llm import _spark

    made = _spark.cut_columnar(spark.range(5))
    assert made.count() == 5 and made.dtypes == spark.range(5).dtypes
    assert _spark.cut_columnar(spark.range(0)).count() == 0
    assert _spark.cut(spark.range(3)).count() == 3
    path = made.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    _spark.clear(spark)
    assert not os.path.exists(path)


# 1


def brute_hits(texts, items):
    windows = {}
    for item, text in items:
        w = ALNUM.findall(low(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for t in texts:
        w, on, found = ALNUM.findall(low(t)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    on |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(on), ",".join(sorted(str(x) for x in found if x is not None))))
    return out


@pytest.mark.parametrize("block", [(1 << 20, 1 << 20), (0, 1 << 20), (0, 1 << 18)])
def test_decontamination(spark, block):
    r = random.Random(2)
    items = [(i, prose(r, n, 30)) for i, n in enumerate([30, 12, 10, 9, 3, 1, 0, 40])] + [(100, None), (None, prose(r, 11, 30)), (3, prose(r, 20, 30))]
    texts = [*ODD]
    for _ in range(60):
        parts = [prose(r, r.randint(0, 40), 30)]
        for _ in range(r.randint(0, 2)):
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(w) - 10))
            parts += [" ".join(w[a : a + r.randint(8, 15)]), prose(r, 5, 30)]
        texts.append(" ".join(parts).upper() if r.random() < 0.3 else " ".join(parts))
    texts += [texts[20], texts[20], prose(r, 200_000, 30) + " " + items[7][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    rows = sorted(decontaminate.decontaminate(docs, bench, *block).collect(), key=lambda x: x.doc_id)
    assert [(x.n_words, x.n_hit, ",".join(x["items"])) for x in rows] == brute_hits(texts, items)
    assert all(sum(b - a for a, b in zip(x.spans[::2], x.spans[1::2])) == x.n_hit for x in rows)
    clean = decontaminate.clean(docs, bench, *block)
    assert clean.schema == docs.schema and {x.doc_id for x in clean.collect()} == {x.doc_id for x in rows if not x.n_hit}
    assert {x.n_hit for x in decontaminate.decontaminate(docs, bench.limit(0), *block).collect()} == {0}
    assert decontaminate.decontaminate(docs.limit(0), bench, *block).count() == 0


# 2


def test_licences(spark):
    def places(w, phrase):
        p = phrase.split()
        return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]

    r = random.Random(3)
    full = [t.text for t in licenses.TEMPLATES]
    notices = [*full, "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0", "under the MIT licence", "gnu license version", "cc by nc sa"]

    def changed(t):
        w = t.split()
        for _ in range(r.randint(0, 6)):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 2)] = [prose(r, r.randint(0, 2))] if r.random() < 0.7 else []
        return " ".join(w)

    texts = [*ODD, *full, *(f"{prose(r, r.randint(0, 20))} {changed(r.choice(notices))} {prose(r, 5)} {r.choice(notices)}" for _ in range(150)), "under the mit license " * 50, "of the software and " * 400, "x " * 600_000 + "cc by nc"]
    docs = docs_of(spark, texts)
    rows = sorted(licenses.scan(docs).collect(), key=lambda x: x.doc_id)
    assert len(rows) == len(texts)
    for x in rows:
        w = ALNUM.findall(low(texts[x.doc_id]))
        base = sorted(p for t in licenses.BASE for p in places(w, t.text))
        score, labels = 0.0, set()
        for t in licenses.TEMPLATES:
            own = [{p - places(t.words, phrase)[0] for p in places(w, phrase)} for phrase in t.phrases]
            off = max(10, len(t.words) // 4)
            for d in own[0]:
                if all(any(abs(e - d) <= off for e in starts) for starts in own):
                    labels.add(t.label)
                    near = {e for starts in own for e in starts if abs(e - d) <= off}
                    score = max(score, sum(any(0 <= e + i < len(w) and w[e + i] == v for e in near) for i, v in enumerate(t.words)) / len(t.words))
        assert (x.n_base, x.first_word, x.last_word) == (len(base), base[0] if base else None, base[-1] if base else None)
        assert x.labels == ",".join(sorted(labels)) and x.score == pytest.approx(score)
        assert set(filter(None, x.base_labels.split(","))) == {t.label for t in licenses.BASE if places(w, t.text)}
    for i, t in enumerate(licenses.TEMPLATES):  # each text has its own label
        assert t.label in rows[len(ODD) + i].labels.split(",") and rows[len(ODD) + i].score == 1
    twice = licenses.scan(docs.unionByName(docs)).groupBy("doc_id", "labels", "n_base").count().collect()
    assert len(twice) == len(texts) and {x["count"] for x in twice} == {2}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_picks_follow_idf_and_agree_between_file_and_template():
    index = licenses.build({"the": 900, "of": 900, "software": 20})
    assert index.window == 3 and index.names.index("the") < index.names.index("software")
    r = random.Random(35)
    for t, x in enumerate(index.texts):
        if len(x) < 3:
            continue
        a = r.randrange(len(x) - 2)
        b = r.randint(a + 3, len(x))
        number = np.concatenate([[-1, -1], x[a:b], [-1]])
        template, start = licenses.proposals(index, number, np.array([0, len(number)]))
        assert (t, 2 - a) in set(zip(template.tolist(), start.tolist()))


# 3


@pytest.mark.parametrize("ranked", [500_000, 20])
def test_packing(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = [*ODD, "<|endoftext|> a  b \n c", "x <|endoftext|><|endoftext|>\n y <|endoftext", "z " * 600_000, *(prose(r, int(r.paretovariate(0.7) * 20) % 3000) for _ in range(150)), "same", "same"]
    docs = docs_of(spark, texts)
    rows = packing.pack(docs, vocabulary()).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_bin = {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_bin.setdefault(x.sequence_id, []).append(x)
    assert set(by_doc) == set(range(len(texts)))
    for i, own in by_doc.items():
        ids = np.array(t.encode(texts[i] or "", add_special_tokens=False).ids + [2], "<u4")
        own.sort(key=lambda x: x.piece)
        assert [x.piece for x in own] == list(range(len(own))) and sum(x.length for x in own) == len(ids)
        for k, x in enumerate(own):
            assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())
            assert x.length == 1024 or k == 0
    for own in by_bin.values():
        own.sort(key=lambda x: x.offset)
        assert [x.offset for x in own] == [sum(y.length for y in own[:k]) for k in range(len(own))]
        assert sum(x.length for x in own) <= 1024
    assert len(by_bin) <= -(-sum(x.length for x in rows) // 1024) + 2
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0


def test_packing_of_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "same words here")] * 300 + [(1, "same words here")] * 300, "doc_id long, text string")
    out = packing.pack(rows, vocabulary()).collect()
    assert Counter(x.doc_id for x in out) == {None: 300, 1: 300}
    by_bin = {}
    for x in out:
        by_bin.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert all(o == sum(n for _, n in sorted(own)[:k]) for own in by_bin.values() for k, (o, _) in enumerate(sorted(own)))


def test_fullest_bin_is_fullest():
    r = random.Random(5)
    for _ in range(200):
        counts = {r.randint(1, 60): r.randint(1, 3) for _ in range(r.randint(1, 8))}
        use = packing.fullest(counts, 60)
        best, first = 0, max(counts)
        sums = {first}
        for n, c in counts.items():
            for _ in range(c - (n == first)):
                sums |= {s + n for s in sums if s + n <= 60}
        best = max(sums)
        assert sum(n * k for n, k in use) == best and all(k <= counts[n] for n, k in use)
        assert sum(t * k for t, u in packing.patterns(counts, 60) for _, k in u) == sum(counts.values())


# 4


PAGE = """<!DOCTYPE html><html><head><title>T &am</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul>{nav}</ul></nav><div class="ad">Buy</div><main><div id="cookie-notice">c</div><article class="post"><h1>Title {n}</h1><p>One<br>two &amp; &nbsp;three <a href=x>link</a>.
<p>Next<form><input value=1>F</form>{more}<div class="advert">AD</div><section id="comments"><p>reader</p></section></article><aside>s</aside></main><footer>&copy; f</footer><script>if (a<b) "</p>"</script></body></html>"""


def test_html(spark):
    pages = [(n, f"https://h.example/{n}", PAGE.format(n=n, nav="<li><a href=/>x</a>" * (2 + n % 3), more="<ul><li>i<li>j</ul>" if n % 2 else "")) for n in range(12)]
    pages += [(50, None, None), (51, "no scheme", ""), (52, "http://e/", "plain < text & more"), (53, "http://e/", "<p>a<p>b<b>c</b> d"), (0, "https://h.example/0", pages[0][2]), (54, "http://e/", "<div>" * 3000 + "deep" + "</div>" * 2990 + "<p>after</p>"), (None, "http://f/", "<article>x</article><footer>y</footer>")]
    df = spark.createDataFrame([(*p, "e") for p in pages], "page_id long, url string, html string, text string")
    for bound in (1 << 20, 0):
        got = html.main_text(df, bound).collect()
        assert len(got) == len(pages)
        by_id = {}
        for x in got:
            assert x.n_chars == len(x.text)
            by_id.setdefault(x.page_id, []).append(x.text)
        for n in range(12):
            assert set(by_id[n]) == {f"Title {n}\nOne two & three link.\nNext" + ("\ni\nj" if n % 2 else "")}
        assert len(by_id[0]) == 2 and by_id[50] == [""] and by_id[51] == [""] and by_id[53] == ["a\nbc d"] and by_id[54] == ["deep\nafter"] and by_id[None] == ["x"]
        assert by_id[52] == ["plain < text & more"]
    assert html.main_text(df.limit(0)).count() == 0


def html_of(spark, pages, bound=1 << 20):
    return {x.page_id: x.text for x in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), bound).collect()}


def test_html_drops_no_main_text_that_pages_share(spark):
    same = "the same beginning of every page " * 6
    pages = [(n, "http://long/", f"<p>Site<div>{same}{n}</div>") for n in range(6)]
    pages += [(10 + n, "http://copies/", "<main><h1>Title</h1><p>one page in copies</main>") for n in range(6)]
    pages += [(20 + n, "http://whole/", f"<title>{n}</title><div>all there is</div>") for n in range(6)]
    pages += [(30 + n, "http://main/", f"<div>Site</div><main><p>in all pages<p>own {n}</main>") for n in range(6)]
    pages += [(40 + n, "http://some/", f"<p>own {n}" + "<p>on few pages" * (n < 3)) for n in range(9)]
    pages += [(50 + n, "http://blocks/", f"<div class='main-story'>a{n}</div><div class='p2'>b{n}</div><h2>c</h2><div class='post-text'>d{n}</div>") for n in range(3)]
    got = html_of(spark, pages)
    for n in range(6):
        assert got[n] == f"{same}{n}" and got[10 + n] == "Title\none page in copies" and got[20 + n] == "all there is"
        assert got[30 + n] == f"in all pages\nown {n}"
    for n in range(9):
        assert got[40 + n] == f"own {n}" + "\non few pages" * (n < 3)
    for n in range(3):
        assert got[50 + n] == f"a{n}\nb{n}\nc\nd{n}"


def test_html_of_any_depth_and_length(spark):
    deep = "<div>" * 150
    pages = [
        (0, "http://d/", f"<p>body text</p>{deep}<nav>MENU</nav><p>under it<aside>x</aside></p>"),
        (1, "http://d/", f"{deep}<article>found<footer>f</footer></article>"),
        (2, "http://t/", f"<p>a<img src={'x' * 20000}>b</p>"),
        (3, "http://t/", f"<p title='{'> ' * 9000}'>quoted</p>"),
        (4, "http://t/", "<p title=\"never closed>open</p>" + "<a href='x>y</a>" * 3000 + "<p>end"),
        (5, "http://t/", "<p>kept</p><a " + "y " * 9000),
        (6, "http://t/", "<p>" + "word " * 300_000 + "</p>"),
        (7, "http://t/", "<p it's>apostrophe</p><!-- c > --><p>2 < 3 <- 4</p><!doctype x>"),
    ]
    got = html_of(spark, pages)
    assert got[0] == "body text\nunder it" and got[1] == "found" and got[2] == "ab" and got[3] == "quoted"
    assert got[4].endswith("end") and got[5] == "kept" and got[6] == "word " * 299_999 + "word" and got[7] == "apostrophe\n2 < 3 <- 4"


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_html_of_generated_hosts(spark, bound):
    """Sites built around known main text: what was put in must come out, and nothing else."""
    r = random.Random(36)
    pages, want = [], {}
    words = lambda n: " ".join(f"{r.choice('abcdef')}{r.randrange(10**6)}x" for _ in range(n))

    def main_part():
        blocks, lines = [], []
        for _ in range(r.randint(1, 6)):
            kind = r.choice(["p", "p", "h2", "ul", "table", "quote", "entity"])
            if kind in ("p", "h2"):
                a, b = words(5), words(3)
                blocks.append(f"<{kind}>{a} <b class='n{r.randrange(99)}'>{b}</b></{kind}>")
                lines.append(f"{a} {b}")
            elif kind == "ul":
                items = [words(2) for _ in range(r.randint(1, 4))]
                blocks.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
                lines += items
            elif kind == "table":
                cells = [words(1) for _ in range(4)]
                blocks.append(f"<table><tr><td>{cells[0]}<td>{cells[1]}<tr><td>{cells[2]}<td>{cells[3]}</table>")
                lines += cells
            elif kind == "quote":
                x = words(4)
                blocks.append(f"<blockquote><p>{x}</p></blockquote>")
                lines.append(x)
            else:
                x = words(2)
                blocks.append(f"<p>{x} &amp; &eacute;&#x41;\n\t {x}</p>")
                lines.append(f"{x} & éA {x}")
        return "".join(blocks), lines

    furniture = ["<nav><a href=/>{w}</a></nav>", "<div class='sidebar-left'><p>{w}</p></div>", "<aside>{w}</aside>", "<div id='cookie-notice'>{w}</div>", "<div class='ad ad-{n}'>{w}</div>", "<form><input>{w}</form>", "<script>{w}</script>", "<footer>{w}</footer>", "<div class='comments'><p>{w}</p></div>", "<header>{w}</header>", "<style>{w}</style>"]
    for host in range(12):
        frame = host % 3
        before, after = r.sample(furniture, 3), r.sample(furniture, 3)
        site = words(3)
        for n in range(10):
            inner, lines = main_part()
            put = lambda xs: "".join(x.format(w=words(2), n=r.randrange(99)) for x in xs if r.random() < 0.8)
            links = "".join(f"<li><a href=/{k}>{words(1)}</a>" for k in range(r.randint(2, 5)))
            body = (f"<div class=x{r.randrange(10**6)}><article>{inner}{put(r.sample(furniture[:8], 2))}</article></div>", f"<main>{inner}</main><p>{site}</p>", f"<div>{site}</div><ul>{links}</ul><div class='wrap'>{inner}</div>")[frame]
            i = host * 100 + n
            pages.append((i, f"https://H{host}.example/{n}", f"<!DOCTYPE html><html><head><title>{words(1)}</title></head><body>{put(before)}{body}{put(after)}</body></html>"))
            want[i] = "\n".join(lines)
    got = html_of(spark, pages + pages[:5], bound)
    assert {i: got[i] for i in want if got[i] != want[i]} == {} and set(got) == set(want)


@pytest.mark.parametrize("key, part", [("div.commentlist", -1), ("ol.comment-list", -1), ("div.topnav", -1), ("div.site-notices", -1), ("div.cookiebar", -1), ("aside", -1), ("div.ad", -1), ("div.ads-0", -1), ("div.adobe", 0), ("div.canvas", 0), ("div.shadow", 0), ("div.header-text@main", 1), ("div.with-sidebar", 0), ("body.has-sidebar", 0), ("article.comment", -1), ("article.post.sidebar-right", 2), ("main", 1), ("div@navigation", -1), ("div.entry-content", 0), ("section.downloads", 0), ("div.loading", 0), ("p", 0), ("div.breadcrumbs", -1), ("ul.menu-main", -1)])
def test_what_names_mean(key, part):
    assert html._part(key, False) == part


def test_wrapper_is_union_free_and_bounded():
    w = html.merge(html.tree("<ul><li>a<li>b</ul><p>x"), html.tree("<ul><li>c</ul><h2>t</h2><p>y"))
    assert html.expression(w[5]) == "<ul>(<li>#TEXT</>)+</>(<h2>\"t\"</>)?<p>#TEXT</>"
    r = random.Random(6)
    for k in range(60):
        w = html.merge(w, html.tree("".join(f"<{t} class={''.join(r.choices(LETTERS, k=9))}>z</{t}>" for t in r.choices(["h2", "p", "div", "table", "ol"], k=30))))
    assert len(w[5]) <= html.WIDE + 40 and sum(1 for _ in nodes_of(w)) < 300


def nodes_of(node):
    yield node
    for c in node[5]:
        yield from nodes_of(c)


def test_pages_match_their_wrapper():
    r = random.Random(37)
    pages = ["".join(f"<{t}>{r.randrange(9)}<b>{r.randrange(3)}</b></{t}>" for t in r.choices(["p", "h2", "ul", "div class=a1b"], k=r.randint(1, 9))) for _ in range(80)]
    w = html.tree(pages[0])
    for p in pages[1:]:
        w = html.merge(w, html.tree(p))
    whole = html.compiled(w)
    missed = []
    place = html.Wrapper.place
    try:
        html.Wrapper.place = lambda self, key, after: (i := place(self, key, after), missed.append(key) if i < 0 else None)[0]
        for p in pages:
            html.extract(p, whole)
    finally:
        html.Wrapper.place = place
    assert not missed


# 5


def test_quality_statistics():
    r = random.Random(7)
    texts = [*ODD, *("".join(r.choice(["ab ", "ab cd ef ", "#$ ", "É\n", "x\n", "  \n", "Zz! "]) for _ in range(r.randint(0, 80))) for _ in range(100))]
    got = quality.statistics(pa.array(texts))
    for i, t in enumerate(t or "" for t in texts):
        w = SPACED.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        rep = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))
        assert tuple(int(got[b][i]) for b in quality.BASE) == want


@pytest.mark.parametrize("groups", [quality.BROADCAST_GROUPS, 0])
def test_quality_rejects_outliers_and_keeps_prose(spark, monkeypatch, groups):
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", groups)
    r = random.Random(8)
    texts = [prose(r, r.randint(60, 400)).capitalize() + "." for _ in range(600)] + ["%%% ".join(f"w{r.randrange(400)}" for _ in range(100)) for _ in range(20)] + ODD
    docs = docs_of(spark, texts).unionByName(docs_of(spark, texts[:30], lang=None, source=None))
    rows = quality.judge(docs, ("text", "grp")).collect()
    assert len(rows) == len(texts) + 30
    good = [x for x in rows if x.doc_id < 600]
    assert sum(not x.kept for x in good) <= 3
    assert not any(x.kept for x in rows if x.doc_id >= 600)
    assert all(x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) and not (x.base_failed and x.kept) for x in rows)
    assert quality.judge(docs.limit(0)).count() == 0


def test_determinant_estimate_ignores_a_quarter_of_outliers(spark):
    r = np.random.default_rng(9)
    good = r.normal(0, 1, (1500, quality.P))
    bad = r.normal(25, 1, (350, quality.P))
    rows = spark.createDataFrame([("g", *map(float, x)) for x in np.concatenate([good, bad])], "grp string, " + ", ".join(f"{f} double" for f in quality.FLOOR))
    found = quality.estimate(rows).collect()[0]
    assert np.abs(np.array(found.mu)).max() < 0.3


# 6


def test_warc(spark, tmp_path):
    r = random.Random(10)
    shared = [prose(r, 50) for _ in range(5)]
    pages = [(i, f"http://h/{i}", r.choice([*shared, prose(r, 20), None, "", "é\r\n\r\nWARC/1.1\r\n"])) for i in range(200)] + [(None, None, shared[0]), (None, "u", "alone"), (7, "x\r\ny", "twice"), (7, "x", "twice")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, archive int")
    folder = f"file://{tmp_path}/warc"
    rows = warc.archive(df, folder).collect()
    assert len(rows) == len(pages)
    best = {}
    for i, _, h in pages:
        best[h or ""] = max([x for x in (best.get(h or ""), i) if x is not None], default=None)
    digests = {warc.digest_of((h or "").encode()): (h or "") for _, _, h in pages}
    seen = Counter()
    for x in rows:
        payload = digests[x.payload_digest]
        assert x.payload_bytes == len(payload.encode())
        seen[(payload, x.record_type)] += 1
        assert x.refers_to == (best[payload] if x.record_type == "revisit" else None)
        assert x.record_type == "revisit" or x.page_id == best[payload]
    assert all(seen[(p, "response")] == 1 for p in digests.values())
    import gzip

    whole = [p for p in (tmp_path / "warc").iterdir() if p.name.endswith(".warc.gz") and ".members." not in p.name]
    members = [p for p in (tmp_path / "warc").iterdir() if ".members." in p.name]
    count = lambda p: sum(1 for _ in warc.Inflated(open(p, "rb")))
    assert sum(map(count, whole)) == sum(map(count, members)) == len(pages) and all(gzip.open(p).read(5) == b"WARC/" for p in whole + members)
    assert not list((tmp_path / "warc").glob("*.tmp")) and warc.archive(df.limit(0), folder).count() == 0


def test_archives_roll_on_records_and_inflate_in_steps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 7)
    monkeypatch.setattr(warc, "CHUNK", 64)
    big = "y" * 300_000  # some 300 bytes as a stream
    pages = [(i, "u", big if i == 5 else None) for i in range(40)]
    written = list(warc._write(f"file://{tmp_path}")(iter([pa.RecordBatch.from_pylist([{"page_id": i, "url": u, "html": h} for i, u, h in pages], schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]))])))
    assert [b.num_rows for b in written] == [7] * 5 + [5]
    payloads = [p for b in written for _, p in warc.Inflated(open(tmp_path / b.column(0)[0].as_py(), "rb"))]
    assert payloads == [(h or "").encode() for _, _, h in pages]


def test_warc_broken_archive_is_an_error():
    import io
    import zlib as z

    pack = z.compressobj(6, z.DEFLATED, 31)
    raw = pack.compress(warc.record("response", 1, "u", b"payload", {})[:-6]) + pack.flush()
    with pytest.raises(ValueError):
        list(warc.Inflated(io.BytesIO(raw)))


# 7


def shingle_set(t):
    w = ALNUM.findall(low(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(texts):
    s = [shingle_set(t) for t in texts]
    head = list(range(len(texts)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(s))]


def test_near_duplicates(spark):
    r = random.Random(11)
    base = [prose(r, 120, 5000) for _ in range(12)]
    texts = [*ODD, *base]
    for b in base[:6]:
        for n in (1, 2, 3, 5, 20):
            w = b.split()
            for _ in range(n):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(w))
    star = prose(r, 150, 5000).split()
    for _ in range(120):  # copies that are near to their source more than to each other
        w = list(star)
        for _ in range(3):
            w[r.randrange(len(w))] = f"y{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(star), base[0].upper(), base[0] + "!!", base[1] + " " + "again and again " * 40, "tiny text", "tiny, text", " ".join(prose(r, 60, 5000) + " shared passage " + base[3])]
    texts += [base[2]] * 5
    rows = neardup.classes(docs_of(spark, texts)).collect()
    got = {x.doc_id: x.class_id for x in rows}
    assert len(rows) == len(texts) and [got[i] for i in range(len(texts))] == brute_classes(texts)
    kept = neardup.keep_one(docs_of(spark, texts))
    assert kept.columns == docs_of(spark, texts).columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(got.values()))


def test_near_duplicates_odd_tables(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta"
    rows = spark.createDataFrame([(None, t), (None, t), (5, t + "."), (5, t + "."), (5, "other words entirely in this one here"), (None, "nothing like the rest of them at all"), (9, None), (9, None)], "doc_id long, text string")
    got = neardup.classes(rows).collect()
    assert len(got) == 8 and {x.class_id for x in got if x.class_key is not None and x.doc_id != 5} >= {5, None}
    kept = [tuple(x) for x in neardup.keep_one(rows).collect()]
    assert Counter(kept)[(9, None)] == 2 and len([k for k in kept if k[1] and k[1].startswith("alpha")]) == 1
    assert neardup.classes(rows.limit(0)).count() == 0


def test_only_texts_with_the_same_shingles_stand_for_each_other_in_bands():
    words = prose(random.Random(21), 400, 5000).split()
    texts = [" ".join(words), " ".join([*words[:-1], "edited"]), ", ".join(words).upper() + "!"]
    keys = np.arange(3)
    out = next(neardup._sign(iter([pa.RecordBatch.from_arrays([pa.array(keys), pa.array(texts)], names=["key", "text"])])))
    assert [len(x) for x in out.column(1).to_pylist()] == [neardup.BANDS, neardup.BANDS, 0]
    assert out.column(4).to_pylist() == [[], [], [0]]


def test_bands_and_sketches_take_texts_as_sets():
    words = prose(random.Random(22), 300, 5000).split()
    often = words + words[:100] * 40
    full, bands, sketch, whole = neardup.sign(pa.array([" ".join(words), " ".join(often), " ".join(words + words[:100] * 2)]))
    assert (bands[1] == bands[2]).all() and (sketch[1] == sketch[2]).all() and whole[1] == whole[2] != whole[0]
    assert neardup._far(neardup.NEAR) >= 32  # of 128 bits, each different with probability 0.1 at similarity 0.8: more in 2.8e-7


def test_probminhash_estimates_probability_jaccard():
    r = np.random.default_rng(12)
    g = _text.mix(np.arange(300, dtype=np.uint64))
    wa, wb = r.integers(1, 30, 200), r.integers(1, 30, 200)
    own = neardup.registers(np.repeat([0, 1], 200), np.concatenate([g[:200], g[100:]]), np.concatenate([wa, wb]), 2, 4096)
    u, v = np.zeros(300), np.zeros(300)
    u[:200], v[100:] = 1 + np.log10(wa), 1 + np.log10(wb)
    exact = sum(1 / np.maximum(u / u[d], v / v[d]).sum() for d in range(100, 200))
    assert abs((own[0] == own[1]).mean() - exact) < 0.03


def test_a_bucket_of_alike_texts_gives_few_pairs():
    r = np.random.default_rng(13)
    middle = r.integers(-(2**63), 2**63 - 1, 2)
    sketch = np.stack([middle ^ np.array([1 << int(a), 1 << int(b)]) for a, b in r.integers(0, 62, (3000, 2))])
    pairs = list(neardup.Bucket().pairs(np.arange(3000), sketch, True))
    assert 2999 <= sum(len(a) for a, _ in pairs) <= 4 * 3000


def test_links_within_a_family_below_the_threshold(spark):
    r = random.Random(23)
    common = prose(r, 200, 5000).split()
    texts = [" ".join(common + prose(r, 30, 5000).split()) for _ in range(400)]  # similarity about 0.77
    for i in range(100):  # planted: about 0.82
        texts.append(" ".join(texts[i].split()[:-22] + prose(r, 22, 5000).split()))
    sets = [shingle_set(t) for t in texts]
    assert all(len(sets[i] & sets[400 + i]) >= 0.8 * len(sets[i] | sets[400 + i]) for i in range(100))
    got = {x.doc_id: x.class_id for x in neardup.classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


@pytest.mark.parametrize("blocks", [(8000, 4_000_000), (20, 4_000_000), (8000, 4000)])
def test_second_round_leaves_no_link_out(spark, monkeypatch, blocks):
    monkeypatch.setattr(neardup, "ROUND", blocks[0])
    monkeypatch.setattr(neardup, "CELL", blocks[1])
    r = random.Random(24)
    common = prose(r, 120, 5000).split()
    texts = []
    for _ in range(120):  # many near to each other, few of them linked
        w = list(common)
        for _ in range(r.choice([2, 4, 6, 8])):
            w[r.randrange(len(w))] = f"z{r.randrange(40)}"
        texts.append(" ".join(w))
    docs = docs_of(spark, texts).selectExpr("doc_id", "doc_id AS key", "text")
    signed = [(int(k), b, s) for k, b, s in zip(range(len(texts)), neardup.sign(pa.array(texts))[1].tolist(), neardup.sign(pa.array(texts))[2].tolist())]
    large = spark.createDataFrame([(b, k, *s) for k, bands, s in signed for b in bands], "band long, key long, s0 long, s1 long")
    got = {x.node: x.head for x in neardup.components(neardup._left_out(large, spark.createDataFrame([], "node long, head long"), docs).selectExpr("head_a AS a", "head_b AS b")).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == brute_classes(texts)


def test_links_between_classes_are_exact():
    r = np.random.default_rng(25)
    sets = [np.unique(r.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)] + [np.zeros(0, np.uint64)]
    head, block = r.integers(0, 6, 61), r.integers(0, 2, 61)
    for x, y in ((0, 0), (0, 1)):
        want = set()
        for i in range(61):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if head[i] != head[j] and (x == y or block[i] != block[j]) and both and both >= 0.8 * len(np.union1d(sets[i], sets[j])):
                    want.add((min(head[i], head[j]), max(head[i], head[j])))
        found = neardup.between(np.arange(61), head, block, sets, x, y)
        assert {(min(a, b), max(a, b)) for _, _, a, b in found} == want and len(found) == len(want)
        assert all(head[i] == a and head[j] == b for i, j, a, b in found)


def test_texts_of_one_hash_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = random.Random(26)
    texts = [prose(r, 40, 5000) for _ in range(9)]
    monkeypatch.setattr(neardup, "_key", lambda text: F.length(text) % 2)
    got = {x.doc_id: x.class_id for x in neardup.classes(docs_of(spark, texts + texts[:2])).collect()}
    assert got == {i: i % 9 for i in range(11)}


def test_buckets_stream_in_blocks(monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 64)
    r = np.random.default_rng(17)
    rows = []
    for band, n in ((1, 2), (2, 300), (3, 1), (4, 40), (5, 2), (6, 129)):
        middle = r.integers(-(2**63), 2**63 - 1, 2)
        rows += [(band, band * 1000 + i, *(middle ^ np.array([1 << int(a), 1 << int(b)]))) for i, (a, b) in enumerate(r.integers(0, 62, (n, 2)))]
    table = np.array(rows, np.int64)
    names = ["band", "key", "s0", "s1"]
    for size in (7, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(table[i : i + size, k]) for k in range(4)], names=names) for i in range(0, len(table), size)]
        pairs = [(a, b) for x in neardup._candidates(iter(batches)) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist()) if a < b]
        head = {int(k): int(k) for k in table[:, 1]}

        def find(x):
            while head[x] != x:
                x = head[x]
            return x

        for a, b in pairs:
            assert a // 1000 == b // 1000
            a, b = find(a), find(b)
            head[max(a, b)] = min(a, b)
        assert {find(k) for k in head} == {1000, 2000, 3000, 4000, 5000, 6000}
        assert len(pairs) <= 6 * len(table)


# 8


def test_hmm(spark, monkeypatch):
    r = random.Random(14)
    monkeypatch.setattr(hmm, "EMITTED", 50)
    texts = [*ODD, *(" ".join(f"{'AB'[i % 2]}{min(int(r.paretovariate(0.8)), 300)}" for _ in range(r.randint(1, 300))) for i in range(120)), "only held out words?" * 2]
    docs = docs_of(spark, texts)
    for head in (1 << 19, 40):
        monkeypatch.setattr(hmm.vocabulary, "__defaults__", (head,))
        rows = {x.doc_id: x for x in hmm.score(docs, fold(5) == 1).collect()}
        token = [SPACED.findall(low(t)) + [None] for t in texts]
        held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
        c = Counter(x for t, h in zip(token, held) if not h for x in t)
        n, v = sum(c.values()), len(c)
        for i, t in enumerate(token):
            x = rows[i]
            assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
            assert x.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        total = lambda k: sum(getattr(rows[i], k) for i in range(len(texts)) if held[i])
        assert total("score") > total("base_score")
    assert hmm.score(docs.limit(0), fold(5) == 1).count() == 0


def brute_expectations(m, texts):
    """Sums over all state paths of each whole text."""
    from itertools import product

    k = len(m.start)
    starts, moves, emits, likely = np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape), 0.0
    for x in texts:
        paths = {z: m.start[z[0]] * np.prod([m.emit[a, b] for a, b in zip(x, z)]) * np.prod([m.move[a, b] for a, b in zip(z, z[1:])]) for z in product(range(k), repeat=len(x))}
        whole = sum(paths.values())
        likely += np.log10(whole)
        for z, p in paths.items():
            starts[z[0]] += p / whole
            for a, b in zip(z, z[1:]):
                moves[a, b] += p / whole
            for a, b in zip(x, z):
                emits[a, b] += p / whole
    return np.concatenate([starts, moves.ravel(), emits.ravel(), [likely]])


@pytest.mark.parametrize("segment", [1, 2, 3, 512])
def test_expectations_are_those_of_whole_texts(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    r = np.random.default_rng(33)
    part = lambda *n: (x := r.random(n)) / x.sum(-1, keepdims=True)
    m = hmm.Hmm(part(3), part(3, 3), part(3, 5).T.copy())
    texts = [r.integers(0, 5, n).astype("<u2") for n in (1, 2, 3, 4, 5, 7, 7, 1)]
    assert hmm.expect_texts(m, texts, 3) == pytest.approx(brute_expectations(m, texts), rel=1e-5)
    got = hmm.likelihood(m, texts, 3)
    assert got == pytest.approx([brute_expectations(m, [x])[-1] for x in texts])


def test_long_texts_carry_over_cuts():
    r = np.random.default_rng(34)
    m = hmm.initial(np.ones(40), [], 4)
    texts = [r.integers(0, 40, n).astype("<u2") for n in (5000, 1025, 1024, 1)]
    assert hmm.expect_texts(m, texts)[-1] == pytest.approx(hmm.likelihood(m, texts).sum(), rel=1e-5)
    assert hmm.expect_texts(m, texts)[4:20].sum() == pytest.approx(sum(len(x) - 1 for x in texts), rel=1e-4)


def test_training_stops_when_the_likelihood_settles(spark):
    r = np.random.default_rng(15)
    rows = spark.createDataFrame([(bytearray(np.asarray(r.integers(0, 40, 300) + 40 * (i % 2), "<u2").tobytes()),) for i in range(40)], "symbols binary")
    _, seen = hmm.train(rows, hmm.initial(np.ones(100), [], 4), 1e-4)
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0] and seen[-1] - seen[-2] < 1e-4 * abs(seen[-1])


def test_delivered_scores_are_probabilities_of_words(spark, monkeypatch):
    monkeypatch.setattr(hmm, "EMITTED", 3)
    kept = {}
    monkeypatch.setattr(hmm, "_score", lambda shared, real=hmm._score: (kept.update(model=shared.value), real(shared))[1])
    texts = ["a b a c d ed", "b a e f a", "a zed", "new ones here ed", None, "x"]
    docs = docs_of(spark, texts)
    rows = {x.doc_id: x for x in hmm.score(docs, fold(5) == 1).collect()}
    m: hmm.Hmm = kept["model"]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = Counter(w for t, h in zip(texts, held) if not h for w in [*SPACED.findall(low(t)), None])
    known = {w: hmm.tokens(pa.array([w or ""])) for w in {w for t in texts for w in [*SPACED.findall(low(t)), None]}}
    hashed = {w: (int(h[0]), int(kind[0])) for w, (h, kind, _) in known.items()}
    own = sorted(c, key=lambda w: (-c[w], np.array(hashed[w][0], np.uint64).view(np.int64)))[:3]
    rest = [w for w in c if w not in own]
    for i, t in enumerate(texts):
        extra, symbols = 0.0, []
        for w in [*SPACED.findall(low(t)), None]:
            kind = hashed[w][1]
            symbols.append(own.index(w) if w in own else 3 + kind)
            if w not in own:
                room = [c[v] for v in rest if hashed[v][1] == kind]
                extra += np.log10((c[w] + 0.5) / (sum(room) + 0.5 * (len(room) + 1)))
        assert rows[i].score == pytest.approx(hmm.likelihood(m, [np.array(symbols)])[0] + extra)


# 9


def test_toxicity(spark):
    r = random.Random(16)
    bad = ["idiot", "moron", "scum"]
    texts, labels = [], []
    for i in range(900):
        w = prose(r, r.randint(20, 120)).split()
        if i % 6 == 0:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad))
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 6 == 0)))
    labels += [(None, 1, 1), (3, 0, None), (10**9, 1, 1), (5, 1, 0)]
    docs, lab = docs_of(spark, [*texts, *ODD]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = fold(4) == 2
    model = toxicity.train(docs.where(~held), lab.where(~held))
    rows = {x.doc_id: x for x in toxicity.score(docs, model, ("text",)).collect()}
    assert len(rows) == len(texts) + len(ODD) and all(0 <= x.score <= 1 for x in rows.values())
    own = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(rows[i].score >= 0.3) == (i % 6 == 0) for i in own]) > 0.95
    assert len(model.index) < 20_000
    for none in (lab.limit(0), lab.where("toxic = 0")):
        m = toxicity.train(docs, none)
        assert {round(x.score, 6) for x in toxicity.score(docs, m).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_ftrl_is_the_scalar_recursion():
    p = toxicity.Params(alpha=0.7, beta=0.9, l1=3.0, l2=0.3, passes=2)
    r = random.Random(31)
    examples = [(np.array(sorted(r.sample(range(8), r.randint(0, 5))), np.int64), r.randrange(2)) for _ in range(60)]
    z, n, z0, n0 = [0.0] * 8, [0.0] * 8, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= p.l1 else -(z[i] - (1 if z[i] > 0 else -1) * p.l1) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)

    def intercept():
        return -z0 / ((p.beta + n0**0.5) / p.alpha + p.l2)

    for _ in range(p.passes):
        for f, y in examples:
            w, w0 = {i: weight(i) for i in f.tolist()}, intercept()
            g = 1 / (1 + np.exp(-(sum(w.values()) + w0))) - y
            for i, v in w.items():
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha
                z[i] += g - sigma * v
                n[i] += g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / p.alpha * w0
            n0 += g * g
    got, got0 = toxicity.fit(examples, p, 3)
    assert got == pytest.approx([weight(i) for i in range(8)]) and got0 == pytest.approx(intercept()) and 0 < np.count_nonzero(got) < 8


def test_toxicity_takes_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i % 4} {'bad' if i % 2 else 'good'} {i}") for i in range(400)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    one = toxicity.train(docs, lab)
    two = toxicity.train(docs.groupBy("doc_id").agg({"text": "min"}).toDF("doc_id", "text"), lab)
    assert one.intercept == two.intercept and list(one.index) == list(two.index)


# 10


def test_hosts(spark):
    urls = ["http://A.Example.net/en/x?y", "http://example.net/en", "http://b.net", "http://b.net/", "https://x.example.com/de/1", "https://badexample.com/de/1", "http://w.org/fr/1#a/b", "http://w.org?q=/fr/", "no scheme", None, "", "a://b://c/d", "http://bad.info/1", "http://good.info/1", "HTTP://U.net:80/en/é"]
    pages = [(i, u, "h") for i, u in enumerate(urls)] + [(100 + i, f"http://bad.info/{i}", "h") for i in range(60)] + [(300 + i, f"http://good.info/{i}", "h") for i in range(60)] + [(None, "http://bad.info/x", "h")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    out = spark.createDataFrame([(i, i >= 300) for i in range(100, 360) if i < 160 or i >= 300] + [(None, True), (301, None)], "page_id long, good boolean")
    rows = hosts.judge(df, out, RULES).collect()
    assert len(rows) == len(pages)
    got = {x.page_id: x for x in rows}
    at = lambda i: (got[i].host, got[i].path, got[i].rule, got[i].verdict)
    assert at(0) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert at(1) == ("example.net", "/en", "net/", "block")
    assert at(2)[:3] == ("b.net", "", None) and at(3)[2:] == ("net/", "block")
    assert at(4)[2:] == ("example.com/de/", "block") and at(5)[2] is None
    assert at(6)[1:3] == ("/fr/1", "org/fr/") and at(7)[:3] == ("w.org", "", None)
    assert at(8)[:3] == at(9)[:3] == at(10)[:3] == ("", "", None) and at(11)[:2] == ("b:", "//c/d")
    assert at(12)[3] == at(100)[3] == at(None)[3] == "block" and at(13)[3] == "allow" and at(14)[:2] == ("u.net:80", "/en/é")
    assert {x.verdict for x in hosts.judge(df, out.limit(0), []).collect()} == {"allow"}
    assert hosts.judge(df.limit(0), out, RULES).count() == 0


def test_host_posteriors_shrink(spark):
    pages = [(i, f"{'a' if i < 50 else 'b' if i < 52 else 'c'}.d{i % 3}.com") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, host string")
    out = spark.createDataFrame([(i, i % 2 == 0) for i in range(52)], "page_id long, good boolean")
    for x in hosts.reputation(df, out).collect():
        assert 0 <= x.below <= 1 and 0 < x.mean < 1


def test_beta_distribution_function(spark):
    from pyspark.sql import functions as F

    r = random.Random(32)
    rows = [(10 ** r.uniform(-3, 4.5), 10 ** r.uniform(-3, 4.5)) for _ in range(150)] + [(1.0, 1.0), (0.5, 0.5), (3.0, 1.0), (1e-9, 1.0), (2000.0, 2010.0), (1.0, 1e-9)]
    for x in (0.5, 0.1):
        got = spark.createDataFrame(rows, "a double, b double").select("a", "b", hosts.beta_cdf(F.col("a"), F.col("b"), x).alias("p")).collect()
        for v in got:
            # stepping a up by one lowers the function by a term in closed form, until it vanishes
            lg, lower, a, b = math.lgamma, 0.0, v.a, v.b
            for n in range(400_000):
                t = math.exp(lg(a + b + n) - lg(a + n + 1) - lg(b) + (a + n) * math.log(x) + b * math.log(1 - x))
                lower += t
                if t < 1e-14 and a + n > x * (a + b + n):
                    break
            assert v.p == pytest.approx(lower, abs=1e-7), (x, v)


def test_levels_of_hosts(spark):
    from pyspark.sql import functions as F

    want = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com:8080": ("com", "y.com"), "u:p@y.com": ("com", "y.com"), "10.0.0.1:80": ("", "10.0.0.1"), "[::1]:80": ("", "[::1]"), "y.com.": ("com", "y.com"), "localhost": ("localhost", "localhost"), "": ("", "")}
    rows = spark.createDataFrame([(h,) for h in want], "host string").withColumns(hosts.levels(F.col("host"))).collect()
    assert {x.host: (x.suffix, x.domain) for x in rows} == want
    tied = [hosts.Rule("block", "b", "/x"), hosts.Rule("allow", "b", "/x")]
    assert spark.range(1).select(hosts.rule_of(F.lit("a.b"), F.lit("/x"), tied, "verdict"), hosts.rule_of(F.lit("a.b"), F.lit("/x"), tied[::-1], "verdict")).first()[:] == ("allow", "block")


# All operators on documents


@pytest.fixture(scope="module")
def odd(spark):
    """Prose, a text beyond the size that is handled at once, repeated rows, and texts of null and of repeated ids."""
    r = random.Random(41)
    long = " ".join(f"w{r.randrange(3000)}" for _ in range(300_000))
    assert len(long) > _text.SEGMENT
    texts = [prose(r, 120, 3000) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, long), (100, long), (101, long + " more"), (7, "another text of this id"), (None, texts[3]), (None, texts[3]), (None, None), (102, None), (103, "")]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), [t for _, t in rows]


def of_texts(rows, column):
    out = {}
    for x in rows:
        out.setdefault(x.doc_id, []).append(getattr(x, column))
    return out


def test_odd_documents_in_scans(spark, odd):
    df, texts = odd
    bench = spark.createDataFrame([(1, " ".join(texts[60].split()[200_000:200_012])), (2, texts[3])], "item_id long, text string")
    hit = of_texts(decontaminate.decontaminate(df, bench).collect(), "n_hit")
    assert hit[100] == [12, 12] and hit[101] == [12] and hit[3] == [120] and hit[None].count(120) == 2 and hit[None].count(0) == 1 and sorted(hit[7]) == [0, 0]
    assert Counter(x.doc_id for x in decontaminate.clean(df, bench).collect())[None] == 1
    found = licenses.scan(df).collect()
    assert len(found) == len(texts) and of_texts(found, "n_words")[100] == [300_000] * 2


def test_odd_documents_in_quality(spark, odd):
    df, texts = odd
    rows = quality.judge(df, ("text",)).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for x in rows:
        by_text.setdefault(x.kept_text, set()).add((x.kept, x.distance))
    assert all(len(v) == 1 for v in by_text.values())  # equal rows are judged alike
    assert of_texts(rows, "n_words")[100] == [300_000] * 2 and not any(of_texts(rows, "kept")[102] + of_texts(rows, "kept")[103])
    same = df.limit(0).unionByName(spark.createDataFrame([(i, texts[0], "en", "s", 0) for i in range(80)], df.schema))
    assert {(x.kept, round(x.distance, 6)) for x in quality.judge(same).collect()} == {(True, 0)}  # all distances tie


def test_odd_documents_in_models(spark, odd):
    df, texts = odd
    held = fold(5) == 1
    scores = of_texts(hmm.score(df, held).collect(), "score")
    assert sum(map(len, scores.values())) == len(texts) and scores[100][0] == pytest.approx(scores[100][1]) and all(np.isfinite(v) for x in scores.values() for v in x)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(3, 1, 0), (3, 1, 1), (100, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    rows = of_texts(toxicity.score(df, model).collect(), "score")
    assert sum(map(len, rows.values())) == len(texts) and rows[100][0] == rows[100][1] and rows[None].count(rows[3][0]) >= 2


def test_odd_documents_in_near_duplicates(spark, odd):
    df, texts = odd
    rows = of_texts(neardup.classes(df).collect(), "class_id")
    assert rows[100] == [100, 100] and rows[101] == [100] and rows[3] == [3] and rows[None].count(3) == 2 and rows[102] == [102] and rows[103] == [103]


def test_quality_distances_are_those_of_least_determinants(spark):
    """Against a plain form that sorts distances instead of binning them."""
    r = np.random.default_rng(42)
    mix = r.normal(size=(quality.P, quality.P))
    data = np.concatenate([r.normal(size=(1200, quality.P)) @ mix, r.normal(12, 1, size=(250, quality.P))])
    floor = np.diag(np.array(list(quality.FLOOR.values())) ** 2)
    h = int(np.ceil(0.75 * len(data)))
    best = np.inf
    for _ in range(30):  # random starts
        own = data[r.choice(len(data), quality.P + 1, False)]
        for _ in range(30):
            mu, cov = own.mean(0), np.cov(own.T, bias=True)
            d = np.einsum("ij,jk,ik->i", data - mu, np.linalg.inv(cov + floor), data - mu)
            own = data[np.argsort(d)[:h]]
        best = min(best, np.linalg.slogdet(np.cov(own.T, bias=True) + floor)[1])
    rows = spark.createDataFrame([("g", *map(float, x)) for x in data], "grp string, " + ", ".join(f"{f} double" for f in quality.FLOOR))
    found = quality.estimate(rows).collect()[0]
    scatter = np.array(found.scatter).reshape(quality.P, quality.P)
    d = np.einsum("ij,jk,ik->i", data - np.array(found.mu), np.linalg.inv(scatter), data - np.array(found.mu))
    own = data[np.argsort(d)[:h]]
    assert np.linalg.slogdet(np.cov(own.T, bias=True) + floor)[1] <= best + 0.02
    assert np.median(d) == pytest.approx(quality.chi2(0.5), rel=0.02) and (d[1200:] > quality.chi2(quality.CUTOFF)).all() and (d[:1200] < quality.chi2(quality.CUTOFF)).all()


def test_small_groups_lean_on_their_language(spark):
    r = np.random.default_rng(43)
    draw = lambda lang, source, n, at: [(lang, source, *map(float, r.normal(at, 1, quality.P))) for _ in range(n)]
    rows = spark.createDataFrame(draw("en", "big", 2000, 0) + draw("en", "small", 3, 9) + draw("en", "middle", 400, 9), "lang string, source string, " + ", ".join(f"{f} double" for f in quality.FLOOR))
    mu = {x.grp: np.mean(x.mu) for x in quality.parameters(rows).collect()}
    at = lambda source: mu[f'{{"lang":"en","source":"{source}"}}']
    assert abs(at("big")) < 0.2 and at("small") < 2 and 7 < at("middle") < 9
