"""Text functions as column expressions, inside whole-stage code generation wherever the built-ins allow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: White space as browsers' regular expressions mean it (Java's \s is ASCII only), for use inside [].
SPACE = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Ideographs and kana, each a token of its own, for use inside [].
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
#: What counts as one model token each; the rest counts as a quarter.
WIDE = CJK + r"\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
#: Chinese digits in order of value, and units.
DIGITS = "零一二三四五六七八九"
UNITS = {"十": 10, "百": 100, "千": 1000}


def either(value: Column, other: Column) -> Column:
    """other where value is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), other)


def tokens(text: Column) -> Column:
    """Lower-case tokens: every CJK character, and runs of anything but space, punctuation and symbols; - . _ ' join."""
    run = rf"(?:[^\s\p{{P}}\p{{S}}{CJK}]|[-._'])+"
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([{CJK}]|{run})"), F.lit(1))


def squeezed(text: str) -> str:
    return "".join(text.lower().split())


def bigrams(query: str) -> list[str]:
    """Distinct neighbouring pairs of the query without its white space."""
    q = squeezed(query)
    return list(dict.fromkeys(q[i : i + 2] for i in range(len(q) - 1)))


def hits(text: Column, grams: list[str]) -> Column:
    """How many of these strings the text contains; a sum of plain predicates stays in generated code."""
    return reduce(Column.__add__, [F.when(F.contains(text, F.lit(g)), 1).otherwise(0) for g in grams], F.lit(0))


def coverage(text: Column, grams: list[str]) -> Column:
    return hits(text, grams) / float(len(grams)) if grams else F.lit(0.0)


def estimate_tokens(text: Column) -> Column:
    """Wide characters count one, others a quarter, rounded half up."""
    # wide characters take three bytes or more, so texts without two bytes too many have none and aren't searched
    wide = F.when(F.octet_length(text) - F.length(text) < 2, F.lit(0)).otherwise(F.regexp_count(text, F.lit(f"[{WIDE}]")))
    return F.floor(wide + (F.length(text) - wide) / 4 + 0.5).cast("long")


def natural_key(text: Column, width: int = 20) -> Column:
    """A key whose byte order compares runs of digits by value."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, width, "0")).otherwise(x)), "")


def term_key(text: Column) -> Column:
    """Lower case without separators."""
    return F.regexp_replace(F.lower(text), "[ ·\\-—_、，,.。]", "")


def strip_ordinal(text: Column) -> Column:
    """Without one leading ordinal, unless nothing else would stay."""
    bare = F.regexp_replace(text, r"^\s*(?:第?[0-9一二三四五六七八九十百]+[章节条、.．)）]|[(（][0-9一二三四五六七八九十]+[)）])\s*", "")
    return F.when(bare == "", text).otherwise(bare)


def lead_summary(text: Column, most: int = 70) -> Column:
    """First sentence without quote and heading marks, cut to ``most`` characters with an ellipsis."""
    plain = F.trim(F.regexp_replace(text, r"(?m)^[>#\s]+", ""))
    first = F.regexp_extract(plain, r"^([^。！？.!?\n]*[。！？.!?]?)", 1)
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 2), F.lit("…"))).otherwise(first)


def excerpt(text: Column, query: str, width: int) -> Column:
    """A window around the first hit of the query, of it without spaces, or of any of its bigrams; short texts whole."""
    flat = F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))
    low = F.lower(flat)
    wanted = list(dict.fromkeys([query.lower(), squeezed(query), *bigrams(query)]))
    place = F.coalesce(*[F.nullif(F.instr(low, w), F.lit(0)) for w in wanted], F.lit(1))
    start = F.greatest(F.lit(1), F.least(place - width // 2, F.length(flat) - width + 1))
    cut = F.substring(flat, start, F.lit(width))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + width - 1 < F.length(flat), "…").otherwise("")))


def cn_number(text: Column) -> Column:
    """Value of an Arabic or Chinese numeral below ten thousand; null where it isn't one, or is zero."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"), F.lit(True).alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        digit = F.instr(F.lit(DIGITS), c) - 1
        unit = reduce(lambda e, k: F.when(c == k, UNITS[k]).otherwise(e), UNITS, F.lit(0))
        filled = F.when(acc.digit == 0, 1).otherwise(acc.digit)
        return F.struct(
            F.when(unit > 0, acc.total + filled * unit).otherwise(acc.total).alias("total"),
            F.when(unit > 0, 0).otherwise(digit).alias("digit"),
            (acc.ok & ((unit > 0) | (digit >= 0))).alias("ok"),
        )

    found = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda a: F.when(a.ok, a.total + a.digit))
    return F.nullif(F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int")).otherwise(found), F.lit(0))


def first_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"((?:19|20)[0-9]{2})", 1), F.lit(""))


def slug(text: Column) -> Column:
    """Path segments with spaces as hyphens, & spelt out, ? and # and % dropped or replaced; no slash at the ends."""
    out = F.regexp_replace(text, r"\s", "-")
    for a, b in (("&", "-and-"), ("%", "-percent"), (r"[?#]", "")):
        out = F.regexp_replace(out, a, b)
    return F.regexp_replace(out, "^/+|/+$", "")


def prefixes(path: Column, separator: str = "/") -> Column:
    """Every proper prefix of a path, outermost first."""
    parts = F.split(path, f"[{separator}]")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), separator))


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits."""
    data = F.hex(F.encode(text, "utf-8"))
    count = F.length(data) / 2
    bytes_ = F.transform(F.sequence(F.lit(1), F.greatest(count.cast("int"), F.lit(1))), lambda i: F.conv(F.substring(data, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    value = F.aggregate(bytes_, F.lit(2166136261).cast("long"), lambda h, b: h.bitwiseXOR(b) * 16777619 % (1 << 32))
    return F.when(text == "", F.lit(2166136261).cast("long")).otherwise(value)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of normalised vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cn_numeral(number: Column) -> Column:
    """1..99 as a Chinese numeral; null outside."""
    digit = lambda n: F.substring(F.lit(DIGITS), n + 1, F.lit(1))
    tens, ones = F.floor(number / 10).cast("int"), (number % 10).cast("int")
    return F.when(number.between(1, 99), F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(ones)).otherwise("")))


def arabic_label(label: Column) -> Column:
    """The first Chinese numeral after 第 in a label as digits; labels without one stay."""
    numeral = F.regexp_extract(label, "第([零一二三四五六七八九十百千]+)", 1)
    value = cn_number(F.nullif(numeral, F.lit("")))
    return F.when(value.isNotNull(), F.replace(label, F.concat(F.lit("第"), numeral), F.concat(F.lit("第"), value.cast("string")))).otherwise(label)


def file_name(text: Column, default: str = "untitled", most: int = 40) -> Column:
    """A name without characters that paths can't have, hyphens at its ends or more than ``most`` characters."""
    bare = F.regexp_replace(F.trim(text), r'[\\/:*?"<>|#^\[\]\s]+', "-")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(F.regexp_replace(bare, "^-+|-+$", ""), 1, most), "-+$", ""), F.lit("")), F.lit(default))


def escaped(text: Column) -> Column:
    """Markdown's own characters with a backslash before them."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>#|])", r"\\$1")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n[ \t]*\r?\n"), F.trim), lambda x: x != "")


def node_size(level: Column, degree: Column, base: dict[str, float]) -> Column:
    """A term's size grows with the root of its degree from 6 to 14, others' by 4 at most from their level's base."""
    start = F.coalesce(*[F.when(level == k, F.lit(float(v))) for k, v in base.items()], F.lit(4.0))
    return F.when(level == "term", F.least(F.lit(14.0), 6 + F.sqrt(degree))).otherwise(start + F.least(F.lit(4.0), F.sqrt(degree)))


def congruential(seed: Column) -> Column:
    """The next number of the linear congruential generator with 1664525 and 1013904223, 32 bits."""
    return (seed.cast("long") * 1664525 + 1013904223) % (1 << 32)


def shuffle_key(id_: Column, seed: int) -> Column:
    """Rows ordered by this key are shuffled, the same for the same seed."""
    return F.xxhash64(id_.cast("string"), F.lit(seed))
