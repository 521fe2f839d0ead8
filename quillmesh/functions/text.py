"""Text functions of the page model: normal forms, code masking, links, summaries, rewriting.

Whatever a column expression can state stays one; fences, which need state
from line to line, are one regular expression with a back reference.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.refs import REF_RE

# The blocks whose characters make a term a CJK term.
CJK = "぀-ゟ゠-ヿ一-鿿㐀-䶿"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUMMARY_LIMIT = 120

# Code, from the description of CommonMark, for Java and Python alike.  A fence is a line of three backticks or tildes,
# indented by three blanks at most, up to the next one of its kind or, if there is none, the end of the text.
FENCE_LINE = r"^ {0,3}(```|~~~)"
_KIND = r"^ {{0,3}}{0}(?:(?!^ {{0,3}}{0})[\s\S])*+(?:^[^\n]*)?"
_FENCES = _KIND.format("`{3}") + "|" + _KIND.format("~{3}")
FENCED = f"(?m){_FENCES}"
# A code span lies on one line, between two runs of backticks of equal length.
CODE_SPAN = r"(?<!`)(`++)([^\n]*?[^`\n])\1(?!`)"
LINK = r"\[\[([^\[\]\n]+)\]\]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    codes, values = pd.factorize(s)
    done = [unicodedata.normalize("NFC", v) for v in values]
    return pd.Series([done[k] if k >= 0 else None for k in codes], dtype=object)


#: Declared nondeterministic so that a condition on a normal form does not compute it twice.
_nfc = _nfc.asNondeterministic()


def nfc(c: Column) -> Column:
    """Canonical composition. There is no built-in for it, so it runs once, when an index is built."""
    return _nfc(c)


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only: other letters stay as they are."""
    return F.translate(c, _UPPER, _LOWER)


def normalize(c: Column) -> Column:
    """The form in which query terms and fields are compared."""
    return ascii_lower(nfc(c))


def normalize_py(s: str) -> str:
    return unicodedata.normalize("NFC", s).translate(str.maketrans(_UPPER, _LOWER))


def is_cjk(term: str) -> bool:
    return re.search(f"[{CJK}]", term) is not None


def lf(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def outside_fences(body: Column) -> Column:
    """A body without its fenced code; an unclosed fence runs to the end, and the two kinds of fence do not close each other."""
    return F.regexp_replace(lf(body), FENCED, "")


def outside_code(body: Column) -> Column:
    return F.regexp_replace(outside_fences(body), CODE_SPAN, " ")


def body_links(body: Column) -> Column:
    """What double brackets outside code name, in order, repeated links included."""
    return F.regexp_extract_all(outside_code(body), F.lit(LINK), F.lit(1))


def canonical_links(body: Column) -> Column:
    return F.filter(body_links(body), lambda x: x.rlike(REF_RE))


def has_h1(body: Column) -> Column:
    """Whether a first-level heading stands outside fences."""
    return outside_fences(body).rlike(r"(?m)^#(?![^ \n])")


def summary_of(body: Column) -> Column:
    """The first line of running text, trimmed, at most 120 code points; empty if there is none.

    Code, headings, quotes, tables, list items, comments and rules are passed
    over; a comment that opens a line takes all lines up to its end.
    """
    t = F.regexp_replace(outside_fences(body), r"(?m)^[ \t]*<!--(?:(?!-->)[\s\S])*+(?:-->[^\n]*)?", "")
    lines = F.transform(F.split(t, "\n"), lambda l: F.regexp_replace(l, r"^[\s　]+|[\s　]+$", ""))

    def running(line: Column) -> Column:
        item = line.rlike(r"^(?:[-+*]|[0-9]+[.)]) ")
        bare = F.translate(line, " \t", "")
        rule = (F.length(bare) >= 3) & bare.rlike(r"^(?:-+|_+|[*]+)$")
        return (line != "") & ~F.substring(line, 1, 1).isin("#", ">", "|") & ~item & ~rule

    return F.coalesce(F.substring(F.get(F.filter(lines, running), F.lit(0)), 1, SUMMARY_LIMIT), F.lit(""))


def rewrite_links(body: Column, mapping: dict[str, str]) -> Column:
    """struct(text, count): links outside code whose target is a key of mapping, rewritten.

    The mapping is the list of moved refs of one command and travels with the
    function; everything else of the text stays byte by byte.
    """
    return _rewrite(body, mapping.get)


def rewrite_topic_links(body: Column, old: str, new: str) -> Column:
    """struct(text, count): links outside code to any ref of topic old, rewritten to topic new.

    Only bodies that hold such a link at all are split at their code; of the
    others the struct is as if they had been.
    """
    pattern = re.compile(rf"{re.escape(old)}(/[a-z0-9-]+/[a-z0-9-]+)")

    def to(link: str) -> str | None:
        m = pattern.fullmatch(link)
        return new + m[1] if m else None

    w = _rewrite(F.when(body.contains(f"[[{old}/"), body), to)
    return F.struct(F.coalesce(w["text"], body).alias("text"), w["count"].alias("count"))


def _rewrite(body: Column, to: Callable[[str], str | None]) -> Column:
    @F.pandas_udf("text string, count int")
    def rewrite(texts: pd.Series) -> pd.DataFrame:
        got = [_rewrite_outside_code(t, to) if isinstance(t, str) else (None, 0) for t in texts]
        return pd.DataFrame(got, columns=["text", "count"])

    return rewrite(body)


#: Fenced or inline code, for Python.
_CODE = re.compile(f"(?:{_FENCES})|{CODE_SPAN}", re.M)


def rewrite_py(text: str, mapping: dict[str, str]) -> tuple[str, int]:
    return _rewrite_outside_code(text, mapping.get)


def _rewrite_outside_code(text: str, to: Callable[[str], str | None]) -> tuple[str, int]:
    """Split the text at its code spans and rewrite links in what lies between, where ``to`` has a new target."""
    out, at, count = [], 0, 0

    def one(m: re.Match) -> str:
        nonlocal count
        new = to(m[1])
        if new is None:
            return m[0]
        count += 1
        return f"[[{new}]]"

    for m in _CODE.finditer(text):
        out += [re.sub(LINK, one, text[at : m.start()]), m[0]]
        at = m.end()
    out.append(re.sub(LINK, one, text[at:]))
    return "".join(out), count
