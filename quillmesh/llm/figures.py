"""Figures of form of whole texts, for many texts at once.

The texts of a batch are laid end to end as code points; character classes are
looked up in one table, and whatever is counted by line, word or text is a
difference of running sums at its ends.  Only repeated words, lines and
sentences are told apart text by text, by sets.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Frequent function words of English, German and Spanish, and the particles of Japanese.
COMMON = frozenset((
    "the of and to a in is that it for on are as with was be by at this from or an not have which has but we they can when there if "
    "than so its will would no how what one all were der die das und ist nicht ein eine den dem des zu mit auf von im sich es wir dass "
    "wie wenn oder auch aber bei el la los las de que y en un una por con para no es se del al lo como pero más si su este esta cómo"
).split())
PARTICLES = "のはをがにでともへや"

NAMES = (
    "n_chars n_words n_lines mean_word mean_line symbol_ratio digit_ratio cjk_ratio kana_ratio punct_lines sentence_ends common_words list_chars open_list_chars table_chars "
    "record_chars field_chars grid_chars short_open_chars open_chars inline_list_chars url_chars link_chars run_chars commas one_letter odd_words hex_words distinct_terms "
    "distinct_term_share distinct_line_share distinct_sentence_share vowel_ratio"
).split()

#: Characters that are laid out at once: bounds the memory of a task, not the texts; a longer text is laid out alone.
CHUNK = 500_000

SPACE, LETTER, NUMBER, CJK, KANA, VOWEL, LATIN, PLAIN, HEX, PARTICLE, END, STOP, BLANK, GRID, COMMA = (1 << k for k in range(15))

LIST_LINE = re.compile(r"^[ \t　]*+(?:[-*+•・–—▪◦‣·●○■□][ \t　]*+|\(?+\d++[.)、．][ \t　]*+|[A-Za-z][.)][ \t]++|v\d++(?:\.\d++)++[ \t]++|\[[ xX]\][ \t]*+)\S", re.M)
END_LINE = re.compile(r"[.!?。！？…][\"'”’」』)）\]]*+[ \t\r\f\v]*+$", re.M)
URL = re.compile(r"(?:https?://|www\.)\S+")
LINK = re.compile(r"\[\[[^\]\n]*\]\]")
CELL = re.compile(r"</td>|<tr")

TERM_ENDS, WORD_ENDS, SENTENCE_ENDS = ",、;/", ".,;:!?)", ".!?。！？"


def _split(text: str, ends: str, at: str | None) -> list[str]:
    """The text in parts, any of the ends counting as a separator too."""
    for e in ends:
        if e in text:
            text = text.replace(e, at or " ")
    return text.split(at)


def _bits(ch: str) -> int:
    kind, o = unicodedata.category(ch)[0], ord(ch)
    low = unicodedata.normalize("NFD", ch.lower())[:1]
    return (
        (SPACE if ch in " \t\n\v\f\r" else 0) | (LETTER if kind == "L" else 0) | (NUMBER if kind == "N" else 0) | (CJK if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF else 0)
        | (KANA if 0x3041 <= o <= 0x3096 else 0) | (VOWEL if low in set("aeiouy") and (low != "y" or ch in "yY") and o < 0x180 and ch not in "yY" else 0)
        | (LATIN if kind == "L" and o < 0x180 else 0) | (PLAIN if ch in ".,;:!?'()\"。、/-" else 0) | (HEX if ch in "0123456789abcdefABCDEF" else 0)
        | (PARTICLE if ch in PARTICLES else 0) | (END if ch in "。！？" else 0) | (BLANK if ch in " \t　" else 0) | (GRID if ch in "-+|=: " else 0) | (STOP if ch in ".!?" else 0) | (COMMA if ch in ",、;" else 0)
    )


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    return np.array([_bits(chr(i)) for i in range(0x10000)], np.uint16)


def _classes(c: np.ndarray) -> np.ndarray:
    """Class bits of code points; those beyond the basic plane are classed one by one, each once."""
    out = _table()[np.minimum(c, 0xFFFF)]
    far = np.flatnonzero(c > 0xFFFF)
    if len(far):
        values, at = np.unique(c[far], return_inverse=True)
        out[far] = np.array([_bits(chr(int(v))) for v in values], np.uint16)[at]
    return out


class _Sums:
    """Counts of a flag between positions, from its running sum."""

    def __init__(self, flag: np.ndarray):
        self.s = np.zeros(len(flag) + 1, np.int32)
        np.cumsum(flag, out=self.s[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.s[end] - self.s[start]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _runs(c: np.ndarray, solid: np.ndarray) -> np.ndarray:
    """Characters in something of one to four signs that follows itself three times or more."""
    marked = np.zeros(len(c), bool)
    for k in range(1, 5):
        if len(c) <= k:
            break
        same = np.zeros(len(c) + 1, np.int8)
        same[k:-1] = (c[k:] == c[:-k]) & solid[k:] & solid[:-k]
        step = np.diff(same, prepend=0)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        for a, b in zip(start[end - start >= 3 * k], end[end - start >= 3 * k], strict=True):
            marked[a - k : b] = True
    return marked


def figures(texts: list[str]) -> np.ndarray:
    """One row a text, one column a name of NAMES; line ends are line feeds. A share is 0 where its whole is empty."""
    n_texts = len(texts)
    big = "\n".join(texts) + "\n"
    c = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    bits = _classes(c)
    length = np.array([len(t) for t in texts], np.int64)
    t1 = np.cumsum(length + 1) - 1
    t0 = t1 - length
    is_ = lambda b: (bits & b) != 0
    solid = ~is_(SPACE)
    nxt = np.append(c[1:], 10)
    nxt_space = np.append(~solid[1:], True)
    sums = {k: _Sums(v) for k, v in {
        "solid": solid, "symbol": solid & ~is_(LETTER | NUMBER), "number": is_(NUMBER), "cjk": is_(CJK), "kana": is_(KANA), "vowel": is_(VOWEL), "latin": is_(LATIN), "particle": is_(PARTICLE),
        "comma": is_(COMMA),
        "ends": is_(END) | (is_(STOP) & (nxt_space | (nxt == 41) | (nxt == 34) | (nxt == 0x201D))),
    }.items()}
    of = {k: s(t0, t1).astype(float) for k, s in sums.items()}
    n, cjk = of["solid"], of["cjk"]

    # Lines: every text begins one, and each line feed ends one.
    feeds = np.flatnonzero(c == 10)
    l0, l1 = np.append(0, feeds[:-1] + 1), feeds
    text_of = np.searchsorted(t0, l0, "right") - 1
    by = lambda w: np.bincount(text_of, w, n_texts)
    on = lambda flag: _Sums(flag)(l0, l1)
    width = on(~is_(BLANK) & (c != 10)).astype(float)
    full = sums["solid"](l0, l1) > 0
    listed, ended, cell = np.zeros(len(l0), bool), np.zeros(len(l0), bool), np.zeros(len(l0), bool)
    for flag, pattern in ((listed, LIST_LINE), (ended, END_LINE), (cell, CELL)):
        flag[np.searchsorted(l0, [m.start() for m in pattern.finditer(big)], "right") - 1] = True
    # Between cells: runs of two blanks or more inside a line, or a wide blank.
    blank = np.concatenate(([False], c == 32, [False]))
    b0, b1 = np.flatnonzero(blank[1:] & ~blank[:-1]), np.flatnonzero(~blank[1:] & blank[:-1])
    wide = (b1 - b0 >= 2) & (b0 > 0) & (c[np.maximum(b0 - 1, 0)] != 10) & (c[np.minimum(b1, len(c) - 1)] != 10)
    gap = c == 0x3000
    gap[b0[wide]] = True
    colon = (c == 58) | (c == 0xFF1A)
    first_colon = np.append(np.flatnonzero(colon), len(c))
    first_colon = np.minimum(first_colon[np.searchsorted(first_colon, l0)], l1)
    stops = _Sums((c == 46) | (c == 0x3002))
    head = np.minimum(l0, len(c) - 1)
    field = (on(colon) == 1) & (first_colon > l0) & solid[head] & (first_colon + 1 < l1) & (stops(first_colon, l1) == 0)
    cells = np.maximum.reduce([on(c == 124), on(c == 9), on(gap), on((c == 59) & ~nxt_space & (nxt != 59)), on((c == 44) & ~nxt_space & (nxt != 44))])
    grid = cell | ((l1 - l0 >= 6) & (on(is_(GRID)) == l1 - l0))
    digit = on((c >= 48) & (c <= 57)) > 0
    lines = by(full.astype(float))
    w = np.where(full, width, 0.0)
    table, record, fields = by(w * ((cells >= 2) | grid)), by(w * (digit & ~ended & (cells >= 1))), by(w * (field & ~listed))

    # Words: what stands between blanks.
    edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word_of = np.searchsorted(t0, w0, "right") - 1
    count = lambda flag: np.bincount(word_of, flag, n_texts)
    words = count(np.ones(len(w0)))
    odd = (_Sums(is_(LETTER))(w0, w1) > 0) & (_Sums(solid & ~is_(LETTER | NUMBER | PLAIN))(w0, w1) > 0)
    body = np.where((w1 - w0 > 2) & (c[w0] == 48) & (np.isin(c[np.minimum(w0 + 1, len(c) - 1)], (88, 120))), w0 + 2, w0) if len(w0) else w0
    hexed = (w1 - body >= 2) & (_Sums(is_(HEX))(body, w1) == w1 - body) & (_Sums((c >= 48) & (c <= 57))(body, w1) > 0)

    def spans(p: re.Pattern) -> np.ndarray:
        got = [(m.start(), len("".join(m[0].split()))) for m in p.finditer(big)]
        at = np.array(got, np.int64).reshape(-1, 2)
        return np.bincount(np.searchsorted(t0, at[:, 0], "right") - 1, at[:, 1], n_texts)

    common, terms, term_n, own_lines, sentences, sentence_n = (np.zeros(n_texts) for _ in range(6))
    for i, t in enumerate(texts):
        low = t.lower()
        common[i] = sum(map(COMMON.__contains__, _split(low, WORD_ENDS, None)))
        x = _split(low, TERM_ENDS, None)
        term_n[i], terms[i] = len(x), len(set(x))
        own_lines[i] = len({y for y in map(str.strip, t.split("\n")) if y})
        x = [y for y in map(str.strip, _split(t, SENTENCE_ENDS, "\n")) if y]
        sentence_n[i], sentences[i] = len(x), len(set(x))

    out = {
        "n_chars": length.astype(float), "n_words": words, "n_lines": lines, "mean_word": _share(n, words), "mean_line": _share(n, lines),
        "symbol_ratio": _share(of["symbol"], n), "digit_ratio": _share(of["number"], n), "cjk_ratio": _share(cjk, n), "kana_ratio": of["kana"] / (cjk + 1),
        "punct_lines": _share(by((full & ended).astype(float)), lines), "sentence_ends": _share(of["ends"] * 100, n),
        "common_words": _share(common + of["particle"], words + cjk / 4),
        "list_chars": _share(by(w * listed), n), "open_list_chars": _share(by(w * (listed & ~ended)), n), "table_chars": _share(table, n), "record_chars": _share(record, n),
        "field_chars": _share(fields, n), "grid_chars": _share(np.maximum.reduce([table, record, fields]), n), "short_open_chars": _share(by(w * ((width <= 45) & ~ended)), n),
        "open_chars": _share(by(w * ((width <= 90) & ~ended)), n), "inline_list_chars": _share(by(w * (on((c == 44) | (c == 0x3001)) >= 4)), n),
        "url_chars": _share(spans(URL), n), "link_chars": _share(spans(LINK), n), "run_chars": _share(_Sums(_runs(c, solid))(t0, t1).astype(float), n),
        "commas": _share(of["comma"], words + cjk / 4), "one_letter": _share(count((w1 - w0 == 1).astype(float)), words), "odd_words": _share(count(odd.astype(float)), words),
        "hex_words": _share(count(hexed.astype(float)), words), "distinct_terms": terms, "distinct_term_share": _share(terms, term_n), "distinct_line_share": own_lines / (lines + 1),
        "distinct_sentence_share": _share(sentences, sentence_n), "vowel_ratio": of["vowel"] / (of["latin"] + 1),
    }
    return np.stack([out[k] for k in NAMES], axis=1)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES]))
def figures_udf(texts: pd.Series) -> pd.DataFrame:
    """The figures of each text; a null text counts as an empty one."""
    got = [figures(part) for part in _chunks([t if isinstance(t, str) else "" for t in texts])]
    return pd.DataFrame(np.concatenate(got) if got else np.empty((0, len(NAMES))), columns=NAMES)


#: Read by several expressions, computed once.
figures_udf = figures_udf.asNondeterministic()
