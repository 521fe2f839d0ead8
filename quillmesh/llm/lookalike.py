"""One form for texts that look the same: widths, accents, invisible characters, blanks, hyphens, ligatures, look-alike letters.

``canonical`` is the form to compare by: compatibility normalisation in
composed form, full case folding, every blank as one space, default-ignorable
characters removed, and letters of one script read as those of the script of
their word.  Which letters are drawn alike is Unicode's confusables data, as
Spark's own ICU has it (``confusable_letters``), and a few letters beside it.  ``written_form`` is the same without case folding and leaves what
is normal where it stands (Japanese punctuation, composed accents); a text
that differs from its written form holds at least one character that only
looks like what is normally stored.

Both are computed once per distinct value of an Arrow batch; pure ASCII values
skip all of it.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points that are not displayed (the default-ignorable ranges of Unicode), as class members.
IGNORABLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8"
    "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
BLANK = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0085"
HYPHEN = "‐‑⁃﹘﹣－−"
# Cyrillic and Greek letters drawn like Latin ones, and those Latin letters; they hold where the confusables have another reading.
CYRILLIC = dict(zip("аеорсухіјѕһӏԁԛԝАВЕКМНОРСТУХІЈЅԚԜ", "aeopcyxijshldqwABEKMHOPCTYXIJSQW", strict=True))
GREEK = dict(zip("ονιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oviABEZHIKMNOPTYX", strict=True))
# Letters that pass for Latin only beside Latin ones: as words of their own they are what they are.
BESIDE = dict(zip("αρυκτγωєкмнтвгп", "apuktywekmhtbrn", strict=True))
LATIN_OF = CYRILLIC | GREEK
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items()}
TO_GREEK = {v: k for k, v in GREEK.items()}
_BACK = TO_CYRILLIC | TO_GREEK

_IGN = re.compile(f"[{IGNORABLE}]")
_BLANK = re.compile(f"[{BLANK}]")
_HYPHEN = re.compile(f"[{HYPHEN}]")
_MIXABLE = re.compile("[ɐ-ʯͰ-֏Ꭰ-Ᏽᴀ-ᶿꭰ-ꮿ]")
_WORD = re.compile(r"[A-Za-zªºÀ-ʸ̀-֏Ꭰ-Ᏽᴀ-ᶿḀ-\u1fffꭰ-ꮿ]+")
#: Letters that may be drawn like Latin ones: phonetic, Greek, Cyrillic, Armenian, Cherokee.
_OTHERS = ((0x250, 0x2B0), (0x370, 0x590), (0x13A0, 0x13F6), (0x1D00, 0x1DC0), (0xAB70, 0xABC0))
#: Compatibility forms that differ in width or by joining: full and half width, ligatures, letters as symbols.
_COMPAT = re.compile("[ĲĳŉǄ-ǌǱ-ǳ℀-⅏①-⓿㈀-㏿豈-\ufaffﬀ-ﬆﬓ-ﬗ！-ﾟ￠-￮\U0001d400-\U0001d7ff]")
_WIDE_PUNCT = re.compile("[！-，．／：-＠［-｀｛-･]")
_JAPANESE = re.compile("[、-〿ぁ-ヿ㐀-鿿豈-\ufaffｦ-ﾟ]")


def confusable_letters(spark) -> dict[str, str]:
    """Letters of other scripts and the one Latin letter of the same case that each is drawn like.

    Read from the confusables of Unicode in the ICU that Spark brings along;
    built once on the driver, a few hundred entries.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = [chr(i) for a, b in _OTHERS for i in range(a, b) if unicodedata.category(chr(i))[0] == "L"]
    found = dict(LATIN_OF)
    for c, drawn in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True):
        # The confusables draw capital I as l.
        drawn = "I" if drawn == "l" and c.isupper() else drawn
        if len(drawn) == 1 and drawn.isascii() and drawn.isalpha() and drawn.isupper() == c.isupper():
            found.setdefault(c, drawn)
    return found


def _script(ch: str) -> str:
    o = ord(ch)
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "G"
    if 0x400 <= o <= 0x52F:
        return "C"
    if 0x530 <= o <= 0x58F:
        return "A"
    if 0x13A0 <= o <= 0x13FF or 0xAB70 <= o <= 0xABBF:
        return "K"
    if 0x250 <= o <= 0x2AF or 0x1D00 <= o <= 0x1DBF:
        return "I"
    if 0x300 <= o <= 0x36F:
        return "-"
    return "L"


def _scripts(word: str, table: dict[str, str]) -> str:
    """How a word reads: L, or another script's letter if it is really written in that; with ? before it if every letter is drawn like a Latin one; * if scripts are mixed."""
    kinds = {_script(c) for c in word} - {"-"}
    if kinds <= {"L"}:
        return "L"
    if len(kinds) > 1:
        return "*"
    (kind,) = kinds
    letters = [c for c in word if _script(c) != "-"]
    # A Greek letter on its own is a symbol.
    return "?" + kind if all(c in table for c in letters) and not (kind == "G" and len(letters) == 1) else kind


def _unmix(word: str, table: dict[str, str]) -> str:
    """A word of mixed scripts in one: that of the letters that no other script has, Latin if all could be Latin."""
    own = lambda c: _script(c) != "-" and c not in (table if _script(c) != "L" else _BACK) and c not in BESIDE
    certain = [_script(c) for c in word if own(c)]
    best = max("LCGAKI", key=certain.count)
    if best == "L" or not certain:
        return "".join(table.get(c) or BESIDE.get(c, c) for c in word)
    # Certain letters of several scripts: the greater part holds.
    back = {"C": TO_CYRILLIC, "G": TO_GREEK}.get(best, {})
    return "".join(back.get(c, c) if _script(c) == "L" or "L" not in certain else c for c in word)


def _one_script(text: str, table: dict[str, str]) -> str:
    """Words of mixed scripts read in one; a word that could be Latin is, unless it stands beside a word really in its script, or the text has no letter of another."""
    words = list(_WORD.finditer(text))
    kinds = [_scripts(m[0], table) for m in words]
    if all(k in "LCGAKI" for k in kinds):
        return text
    scripts = {_script(c) for c in text if c.isalpha()} - {"-"}
    out, at = [], 0
    for i, (m, k) in enumerate(zip(words, kinds, strict=True)):
        word = m[0]
        if k == "*":
            word = _unmix(word, table)
        elif k[0] == "?" and scripts != {k[1]} and k[1] not in kinds[max(0, i - 1) : i + 2]:
            word = "".join(table.get(c, c) for c in word)
        out += [text[at : m.start()], word]
        at = m.end()
    return "".join(out) + text[at:]


def _widths(text: str) -> str:
    """Compatibility forms to ordinary ones, but wide punctuation stays beside Japanese text."""
    if not _COMPAT.search(text):
        return text
    out, keep = [], []
    for i, c in enumerate(text):
        if _WIDE_PUNCT.match(c):
            near = text[max(0, i - 1) : i] + text[i + 1 : i + 2]
            if _JAPANESE.search(near) or (_WIDE_PUNCT.search(near) and _JAPANESE.search(text) and not re.search("[A-Za-z]", near)):
                keep.append((i, c))
    stay = dict(keep)
    run: list[str] = []
    for i, c in enumerate(text):
        if i in stay:
            out.append(unicodedata.normalize("NFKC", "".join(run)))
            out.append(stay[i])
            run = []
        elif _COMPAT.match(c) or (run and c in "゙゚ﾞﾟ"):
            run.append(c)
        else:
            out.append(unicodedata.normalize("NFKC", "".join(run)))
            out.append(c)
            run = []
    out.append(unicodedata.normalize("NFKC", "".join(run)))
    return "".join(out)


def written_form(text: str, table: dict[str, str] = LATIN_OF) -> str:
    """The text as it is normally stored. Empty stays empty. table: letters drawn like Latin ones."""
    if text.isascii():
        return text
    t = _IGN.sub("", text)
    t = _BLANK.sub(" ", t)
    t = _HYPHEN.sub("-", t)
    t = _widths(t)
    t = unicodedata.normalize("NFC", t)
    return _one_script(t, table) if _MIXABLE.search(t) else t


def canonical(text: str, table: dict[str, str] = LATIN_OF) -> str:
    """The form to compare by: equal for texts that look the same, whatever their case. Blanks at the ends vanish."""
    t = text
    if not t.isascii():
        t = written_form(t, table)
        t = unicodedata.normalize("NFKC", t)
    t = unicodedata.normalize("NFKC", t.casefold())
    return " ".join(t.split())


def _each(values: pd.Series, f) -> pd.Series:
    """f of each distinct value; null stays null."""
    codes, distinct = pd.factorize(values)
    got = [f(v) for v in distinct]
    return pd.Series([got[k] if k >= 0 else None for k in codes], dtype=object)


def _column(form, df: DataFrame):
    """A column function of one of the forms, by the confusables of the session of df."""
    table = confusable_letters(df.sparkSession)

    @F.pandas_udf(T.StringType())
    def each(values: pd.Series) -> pd.Series:
        return _each(values, lambda v: form(v, table))

    return each


def lookalike_values(df: DataFrame, key: str, fields: list[str], arrays: list[str]) -> DataFrame:
    """key, field, value, written, canonical of each value that is not ASCII; an array field gives one row an element.

    ASCII values are their own written form and are left out before Python
    sees them.  Null values and elements hold nothing.
    """
    one = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]
    d = df.where(F.col(key).isNotNull())
    long = d.select(key, F.explode(F.array(*one)).alias("x")).select(key, "x.field", "x.value")
    for f in arrays:
        long = long.unionByName(d.select(key, F.lit(f).alias("field"), F.explode(f).alias("value")))
    odd = long.where(F.col("value").rlike(r"[^\x00-\x7f]"))
    return odd.withColumns({"written": _column(written_form, df)("value"), "canonical": _column(canonical, df)("value")})


def lookalike_found(df: DataFrame, key: str, fields: list[str], arrays: list[str]) -> DataFrame:
    """Distinct key, field that hold a character which only looks like what is normally stored.

    The value is compared with its form before case folding: folding alone
    would replace joined letters and signs like that of Kelvin on both sides.
    """
    return lookalike_values(df, key, fields, arrays).where("written <> value").select(key, "field").distinct()


def canonical_columns(df: DataFrame, fields: list[str], arrays: list[str]) -> DataFrame:
    """df with a column ``<field>_canonical`` for each field; null stays null, an empty text empty."""
    canonical_udf = _column(canonical, df)
    add = {f"{f}_canonical": canonical_udf(f) for f in fields}
    add |= {f"{f}_canonical": F.when(F.col(f).isNotNull(), F.split(canonical_udf(F.array_join(F.transform(f, lambda x: F.coalesce(F.regexp_replace(x, "\u001f", " "), F.lit(""))), "\u001f")), "\u001f")) for f in arrays}
    return df.withColumns(add)
