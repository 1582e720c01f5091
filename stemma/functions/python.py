"""Text functions that no built-in expresses, as Arrow-batched UDFs over plain Python functions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

#: Named character references that are decoded.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "times": "×", "middot": "·", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "deg": "°"}
#: Subscripts and superscripts, and commands with one character.
SUB, SUP = str.maketrans("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"), str.maketrans("0123456789+-=()", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾")
SYMBOLS = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "mu": "μ", "pi": "π", "times": "×", "cdot": "·", "pm": "±", "leq": "≤", "geq": "≥", "neq": "≠", "rightarrow": "→", "circ": "°", "%": "%", "sim": "~"}


def nfkc_key(text: str) -> str:
    return "".join(unicodedata.normalize("NFKC", text).lower().split())


def decode_entities(text: str) -> str:
    """One pass; a reference that is unknown or no character stays."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] != "#":
            return NAMED.get(body, m[0])
        code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return re.sub(r"&(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z]+);", one, text)


def latex_to_plain(source: str) -> str | None:
    """Plain text of simple formulas: fonts, scripts of digits and signs, single symbols; None for anything else."""
    text = source
    for _ in range(8):
        shorter = re.sub(r"\\(?:mathsf|mathrm|mathbf|mathit|text|operatorname)\s*\{([^{}]*)\}", r"\1", text)
        if shorter == text:
            break
        text = shorter
    text = re.sub(r"\\([A-Za-z]+|%)", lambda m: SYMBOLS.get(m[1], m[0]), text)
    text = re.sub(r"\s+", "", text)

    def script(table: dict) -> Callable[[re.Match], str]:
        def one(m: re.Match) -> str:
            body = m[1] or m[2]
            return body.translate(table) if all(ord(c) in table for c in body) else m[0]

        return one

    text = re.sub(r"_(?:\{([^{}]*)\}|(.))", script(SUB), text)
    text = re.sub(r"\^(?:\{([^{}]*)\}|(.))", script(SUP), text)
    text = re.sub(r"(?<!\\)[{}]", "", text) if not re.search(r"[_^\\]", text) else text
    return None if re.search(r"[\\_^{}]", text) else text


def inline_math(text: str) -> str:
    """$...$ as plain text where it can be; a text with an odd number of $ stays."""
    if text.count("$") % 2:
        return text
    return re.sub(r"\$([^$]*)\$", lambda m: m[0] if (p := latex_to_plain(m[1])) is None else p, text)


def table_to_pipes(html: str) -> str | None:
    """An HTML table as pipe rows, ragged rows padded; None with spanning cells."""
    if re.search(r"(?:row|col)span\s*=\s*[\"']?(?:[2-9]|1\d)", html, re.I):
        return None
    rows = [[re.sub(r"\s+", " ", decode_entities(re.sub(r"<[^>]+>", " ", c))).strip().replace("|", "\\|") for c in re.findall(r"<t[dh][^>]*>(.*?)(?=</?t[dhr]\b|</table|$)", r, re.S | re.I)] for r in re.findall(r"<tr[^>]*>(.*?)(?=<tr\b|</table|</tbody|</thead|$)", html, re.S | re.I)]
    rows = [r for r in rows if r]
    if not rows:
        return None
    width = max(map(len, rows))
    lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
    return "\n".join([lines[0], f"|{' --- |' * width}", *lines[1:]])


_PIECE = re.compile(r'\\.|"|[^"\\]+', re.S)
_CLOSING = re.compile(r'"\s*(?:[,:}\]]|$)')


def repair_json(text: str) -> str | None:
    """JSON whose strings hold bare quotes or line breaks: a quote ends a string only where the text can go on after one."""
    for attempt in (lambda: text, lambda: _repaired(text)):
        try:
            json.loads(out := attempt())
            return out
        except ValueError:
            continue
    return None


def _repaired(text: str) -> str:
    inside = False

    def piece(m: re.Match) -> str:
        nonlocal inside
        if m[0] != '"':
            return re.sub(r"[\r\n]", r"\\n", m[0]) if inside else m[0]
        if inside and not _CLOSING.match(text, m.start()):
            return r'\"'
        inside = not inside
        return m[0]

    return _PIECE.sub(piece, text)


def _udf(f: Callable[[str], str | None]):
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    return run


def nfkc_key_udf():
    return _udf(nfkc_key)


def decode_entities_udf():
    return _udf(decode_entities)


def inline_math_udf():
    return _udf(inline_math)


def table_to_pipes_udf():
    return _udf(table_to_pipes)


def repair_json_udf():
    return _udf(repair_json)
