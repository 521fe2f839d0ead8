"""Markup residue in text: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

A text is parsed into a forest of blocks (headings, list items, quotes, code,
formulas, tables, templates, paragraphs; HTML containers nest).  Each subtree
has a hash of its kind, its text and its children's hashes.  Spark counts per
host on how many pages a subtree occurs; subtrees that recur on a large share
of a host's pages, and large ones that recur on a small share, are the site's
template and are deleted.  What remains is rendered.  Which markup families a text holds comes from the same parse.

Rendered text marks structure by signs of its own: ``\u00a7`` (once per level)
before a heading, ``\u2022`` before a list item (two blanks per level), ``|``
between cells, ``\u300e...\u300f`` lines around code blocks and
``\u27e6...\u27e7`` around formulas.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.text import CODE_SPAN, FENCE_LINE
from quillmesh.session import written

FAMILIES = ("html", "markdown", "wiki", "latex")

# Element names of HTML, and commands of LaTeX that take no argument.
TAGS = frozenset(
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col "
    "colgroup dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 "
    "h6 head header hr html i iframe img input ins kbd label legend li link main map mark math menu meta nav noscript nowiki object ol "
    "optgroup option p param picture pre q ref rp rt ruby s samp script section select small source span strike strong style sub summary "
    "sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
COMMANDS = frozenset(
    "alpha beta gamma delta epsilon varepsilon zeta eta theta lambda mu nu xi pi rho sigma tau phi varphi chi psi omega Gamma Delta Theta "
    "Lambda Pi Sigma Phi Psi Omega cdot cdots ldots dots times div pm mp leq geq le ge neq ne approx equiv sim infty sum prod int partial "
    "nabla in notin subset subseteq cup cap forall exists to rightarrow leftarrow Rightarrow log ln exp sin cos tan max min lim arg item "
    "quad qquad left right noindent maketitle tableofcontents newline par hline centering LaTeX TeX bf it em tt small large Large".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text.
SILENT = re.compile(r"<(script|style|template)(?:\s[^<>]*)?>", re.I)
SILENT_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "template")}

#: Commands whose argument is a name, not text.
SILENT_COMMANDS = frozenset(("label", "cite", "ref", "citep", "citet", "eqref", "usepackage", "documentclass", "includegraphics"))
#: Commands that make a formula with their arguments, and commands of layout.
FORMULA_COMMANDS = frozenset(("frac", "sqrt", "sum"))
LAYOUT_COMMANDS = frozenset(("noindent", "maketitle", "par", "newline", "centering", "hline", "tableofcontents"))
#: Several keys of one argument, which may go on over lines.
KEYS = re.compile(r"\s*(?:[^\s,{}]+\s*,\s*)*[^\s,{}]+\s*")
BLANK_LINE = re.compile(r"\n[ \t]*\n")
BRACES = re.compile(r"[{}\n]")

#: HTML containers in which the text of a list item or heading may stand.
PLAIN = frozenset("<" + t for t in "address article center div header main p section".split())

#: Containers that hold a page's furniture, and the characters that make another text a block of its own.
FURNITURE = frozenset(("<nav", "<header", "<footer", "<aside"))
BLOCK_CHARS = 40
HTML_HEAD = re.compile("<h[1-6]")
FORMULA_ONLY = re.compile("\u27e6[^\u27e6\u27e7]*\u27e7")

#: Private-use signs that the parse puts into the text: a held piece is between the first two, the others begin a block or cell.
SIGNS = re.compile("[\ue000-\ue006]")
BLOCK_SIGNS = re.compile("[\ue002-\ue006]")
HELD = re.compile("\ue000(\\d+)\ue001")
#: Runs of braces, of which templates are made.
RUNS = re.compile(r"\{+|\}+")

FENCE = re.compile(FENCE_LINE)
INLINE_CODE = re.compile(CODE_SPAN)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?)(/?)>")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
AUTOLINK = re.compile(r"<(?:https?://[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>")
DISPLAY = re.compile(r"\$\$(?!\s*\$\$)(.+?)\$\$|\\\[(.+?)\\\]", re.S)
INLINE_MATH = re.compile(r"\\\((.+?)\\\)|(?<![\\$\w])\$(?![\s$])((?:[^$\n\\]|\\.)*?)(?<![\s\\])\$(?![\w$])", re.S)
EQUATION = re.compile(r"\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(.*?)\\end\{\1\}", re.S)
ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?")
COMMAND = re.compile(r"(?<![\w:.\\])\\([A-Za-z]+\*?)((?:\[[^\]\n]*\])?)(\{)?")
WIKI_TABLE = re.compile(r"^[ \t]*\{\|(.*?)^[ \t]*\|\}", re.S | re.M)
WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
WIKI_URL = re.compile(r"\[((?:https?|ftp)://[^\s\]]+)(?:[ \t]+([^\]\n]*))?\](?!\()")
WIKI_QUOTE = re.compile(r"'''''(?=[^'\s])(.+?)'''''|'''(?=[^'\s])(.+?)'''|''(?=[^'\s])([^\n]+?)''(?!')")
WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-{2,})[ \t]*$")
RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
ITEM = re.compile(r"^([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(\S.*)$")
QUOTE = re.compile(r"^ {0,3}>[ \t]?(.*)$")
DELIMITER = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
FOOTNOTE_DEF = re.compile(r"^ {0,3}\[\^[^\]\s]+\]:[ \t]*(.*)$")
REF_DEF = re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'))?[ \t]*$")
MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(\s*<?[^()\s<>]*(?:\([^()\s]*\)[^()\s]*)?>?(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\s*\)")
MD_REF = re.compile(r"(?<![\w\]])!?\[([^\[\]\n^]*[^\W\d_][^\[\]\n]*)\]\[([^\[\]\n]*)\]")
FOOTNOTE = re.compile(r"\[\^[^\]\s]+\]")
STRONG = re.compile(r"\*\*(?=[^\s*])([^\n]+?)(?<=[^\s])\*\*|(?<![\w_])__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?![\w_])")
EMPH = re.compile(r"(?<![A-Za-z0-9*\\])\*(?=[^\s*.,;:/)])([^*\n]*[^\s*])\*(?![A-Za-z0-9*])|(?<![\w\\])_(?=[^\s_])([^_\n]*[^\s_])_(?!\w)")
STRIKE = re.compile(r"~~(?=[^\s~])([^\n]+?)(?<=[^\s~])~~")
HARD_BREAK = re.compile(r"(?<=\S)\\$")
ESCAPE = re.compile(r"\\([*_`#\[\]~>|])")


@dataclass
class Node:
    kind: str
    text: str = ""
    level: int = 0
    children: list = field(default_factory=list)
    digest: str = ""
    #: Texts of the subtree other than headings, code and formulas, and their characters.
    texts: int = 0
    chars: int = 0


def _below(root: Node) -> Iterator[Node]:
    """All nodes below the root, each before its children; any depth."""
    stack = root.children[::-1]
    while stack:
        c = stack.pop()
        yield c
        stack += c.children[::-1]


def _sum_up(root: Node) -> None:
    """Digest and counts of every subtree, children before parents; any depth."""
    for c in reversed([root, *_below(root)]):
        own = f"{c.kind}\x00{c.level}\x00{' '.join(c.text.split())}\x00" + "\x00".join(x.digest for x in c.children)
        c.digest = hashlib.blake2b(own.encode("utf-8", "replace"), digest_size=8).hexdigest()
        if c.kind not in ("heading", "code") and not HTML_HEAD.fullmatch(c.kind):
            mine = bool(c.text) and not FORMULA_ONLY.fullmatch(c.text)
            c.texts = mine + sum(x.texts for x in c.children)
            c.chars = len(c.text) * mine + sum(x.chars for x in c.children)


class Parse:
    """One text's families and blocks. Code and formulas are held aside under private-use signs while the rest is read; such signs of the text itself are held too."""

    def __init__(self, text: str | None, hashes: bool = True):
        self.families: set[str] = set()
        self.held: list[tuple[str, bool]] = []
        self.root = Node("document")
        if text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
            self._read(SIGNS.sub(lambda m: self._hold(m[0], True), text))
        if hashes:
            _sum_up(self.root)

    def _hold(self, text: str, final: bool = False) -> str:
        """A sign that stands for the text; unless it is final, what is held within it is put back with it."""
        self.held.append((text, final))
        return f"\ue000{len(self.held) - 1}\ue001"

    def release(self, text: str) -> str:
        # A piece holds only pieces that were held before it, each by another step of the reading, so this ends soon.
        def one(m: re.Match) -> str:
            body, final = self.held[int(m[1])]
            return body if final else self.release(body)

        return HELD.sub(one, text) if "\ue000" in text else text

    def _sub(self, pattern: re.Pattern, family: str, to, text: str) -> str:
        def one(m: re.Match) -> str:
            got = to(m)
            if got is None:
                return m[0]
            self.families.add(family)
            return got
        return pattern.sub(one, text)

    def _read(self, text: str) -> None:
        text = self._code(text)
        # Whatever follows works on text without Markdown code.
        if "<" in text or "&" in text:
            text = self._html(text)
        if "\\" in text or "$" in text:
            text = self._latex(text)
        if "[" in text or "{" in text or "''" in text:
            text = self._wiki(text)
        self._blocks(text)

    def _code(self, text: str) -> str:
        if "```" in text or "~~~" in text:
            out, mark, code = [], "", []
            for line in text.split("\n"):
                m = FENCE.match(line)
                if mark:
                    if m and m[1] == mark:
                        out.append("\ue002" + self._hold("\n".join(code)))
                        mark = ""
                    else:
                        code.append(line)
                elif m:
                    self.families.add("markdown")
                    mark, code = m[1], []
                else:
                    out.append(line)
            if mark:
                out.append("\ue002" + self._hold("\n".join(code)))
            text = "\n".join(out)
        if "`" in text:
            text = self._sub(INLINE_CODE, "markdown", lambda m: self._hold(m[2].strip() if "\ue000" not in m[2] else m[2]), text)
        return text

    def _html(self, text: str) -> str:
        text = self._silent(self._sub(COMMENT, "html", lambda m: "", text))
        text = re.sub(r"(?is)<pre\b[^<>]*>(.*?)</pre>", self._pre, text)
        text = self._sub(AUTOLINK, "markdown", lambda m: self._hold(m[0][1:-1]), text)

        def tag(m: re.Match) -> str | None:
            name = m[2].lower()
            if name not in TAGS:
                return None
            if name == "br":
                return "\n"
            if name == "hr":
                return "\n\n"
            if name in ("td", "th"):
                return "" if m[1] else "\ue004"
            close = "/" if m[1] else ""
            return f"\n\ue003{close}{name}\ue003\n" if name in BLOCK_TAGS else ""

        if "<" in text:
            text = self._sub(TAG, "html", tag, text)
        if "&" in text:
            def entity(m: re.Match) -> str | None:
                name = m[0][1:]
                if name[0] != "#" and name not in html5:
                    return None
                got = html.unescape(m[0])
                return self._hold("" if got == "\xad" else " " if got == "\xa0" else got, True)
            text = self._sub(ENTITY, "html", entity, text)
        return text

    def _pre(self, m: re.Match) -> str:
        self.families.add("html")
        code = TAG.sub("", m[1])
        return "\n\ue002" + self._hold(html.unescape(self.release(code)).strip("\n"), True) + "\n"

    def _silent(self, text: str) -> str:
        """The text without elements whose content is code. One that is never closed keeps its text and loses its tag with the others."""
        out, at, open_ended = [], 0, set()
        for m in SILENT.finditer(text):
            name = m[1].lower()
            if m.start() < at or name in open_ended:
                continue
            end = SILENT_END[name].search(text, m.end())
            if not end:
                open_ended.add(name)
                continue
            self.families.add("html")
            out.append(text[at : m.start()])
            at = end.end()
        return "".join(out) + text[at:] if out else text

    def _formula(self, body: str) -> str:
        return self._hold("\u27e6" + " ".join(body.split()) + "\u27e7")

    def _latex(self, text: str) -> str:
        text = self._sub(DISPLAY, "latex", lambda m: "\n" + self._formula(m[1] or m[2]) + "\n", text)
        text = self._sub(EQUATION, "latex", lambda m: "\n" + self._formula(m[2]) + "\n", text)
        text = self._sub(INLINE_MATH, "latex", lambda m: self._formula(m[1] or m[2]) if (m[1] or m[2]) else None, text)
        if "\\" not in text:
            return text
        text = self._sub(ENVIRONMENT, "latex", lambda m: "\n", text)
        return self._commands(text)

    def _commands(self, text: str) -> str:
        """Commands as edits of the text: what encloses text loses its name and braces, at any depth; names and formulas go or are held whole."""
        heads = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
        line, part = _braces(text)
        edits: list[tuple[int, int, str]] = []
        at = 0
        for m in COMMAND.finditer(text):
            name = m[1].rstrip("*")
            if m.start() < at or not (m[3] or name in COMMANDS):
                continue
            self.families.add("latex")
            whole = name in COMMANDS or name in FORMULA_COMMANDS
            if not m[3]:
                if name == "item":
                    edits.append((m.start(), m.end(), "\n\ue006"))
                else:
                    edits.append((m.start(), m.end(), "" if name in LAYOUT_COMMANDS else self._formula(m[0])))
                at = m.end()
                continue
            if name in SILENT_COMMANDS:
                # What a silent command names is dropped, so its brace must close on the line or hold nothing but keys.
                end = line.get(m.end(), -1)
                if end < 0:
                    end = text.find("}", m.end())
                    if end >= 0 and not KEYS.fullmatch(text, m.end(), end) or BLANK_LINE.search(text, m.end(), max(end, m.end())):
                        end = -1
                edits.append((m.start(), end + 1 if end >= 0 else m.end(), ""))
                at = edits[-1][1]
                continue
            end = part.get(m.end(), -1)
            stop = end + 1
            if end < 0 and (whole or name in heads):
                # Never closed: it takes what stands on its line.
                end = text.find("\n", m.end())
                end = stop = len(text) if end < 0 else end
            if whole:
                while text[stop : stop + 1] == "{" and stop + 1 in part:
                    stop = part[stop + 1] + 1
                edits.append((m.start(), stop, self._formula(text[m.start() : stop])))
                at = stop
            else:
                edits.append((m.start(), m.end(), f"\n\ue005{heads[name]}\ue005" if name in heads else ""))
                if end >= 0:
                    edits.append((end, stop, "\n" if name in heads else ""))
        out, at = [], 0
        for start, stop, new in sorted(edits, key=lambda e: e[0]):
            if start >= at:
                out += [text[at:start], new]
                at = stop
        return "".join(out) + text[at:]

    def _wiki(self, text: str) -> str:
        if "{|" in text:
            text = self._sub(WIKI_TABLE, "wiki", lambda m: "\n" + self._table(m[1]) + "\n", text)
        if "{{" in text:
            text = self._templates(text)
        if "[[" in text:
            text = self._sub(WIKI_LINK, "wiki", lambda m: self._hold(((m[2] or "").rpartition("|")[2] or m[1].partition("#")[0] or m[1]).strip()), text)
        if "://" in text and "[" in text:
            text = self._sub(WIKI_URL, "wiki", lambda m: m[2] or self._hold(m[1]), text)
        if "''" in text:
            text = self._sub(WIKI_QUOTE, "wiki", lambda m: m[1] or m[2] or m[3], text)
        return text

    def _templates(self, text: str) -> str:
        """The text without templates, nested ones included: double braces that pair up and hold something; a single brace between breaks those around it."""
        opened: list[int] = []
        spans: list[tuple[int, int]] = []
        for m in RUNS.finditer(text):
            n, at = len(m[0]), m.start()
            if m[0][0] == "{":
                if n % 2:
                    opened.clear()
                    at += 1
                opened += range(at, m.end(), 2)
                continue
            for _ in range(n // 2):
                if opened:
                    start = opened.pop()
                    if text[start + 2 : at].strip():
                        while spans and spans[-1][0] > start:
                            spans.pop()
                        spans.append((start, at + 2))
                at += 2
            if n % 2:
                opened.clear()
        if not spans:
            return text
        self.families.add("wiki")
        out, at = [], 0
        for start, stop in spans:
            out.append(text[at:start])
            at = stop
        return "".join(out) + text[at:]

    def _table(self, body: str) -> str:
        rows, row = [], []
        for line in body.split("\n")[1:]:
            line = line.strip()
            if line.startswith("|-"):
                rows.append(row)
                row = []
            elif line.startswith(("|+", "|", "!")):
                row += re.split(r"\|\||!!", line.lstrip("|!+"))
        rows.append(row)
        return "\n".join("\ue004" + "\ue004".join(c.strip() for c in r) for r in rows if r)

    def _inline(self, text: str) -> str:
        if "[" in text:
            text = self._sub(MD_LINK, "markdown", lambda m: m[1], text)
            text = self._sub(MD_REF, "markdown", lambda m: m[1], text)
            text = self._sub(FOOTNOTE, "markdown", lambda m: "", text)
        if "\\" in text:
            text = self._sub(ESCAPE, "markdown", lambda m: self._hold(m[1]), text)
        if "**" in text or "__" in text:
            text = self._sub(STRONG, "markdown", lambda m: m[1] or m[2], text)
        if "~~" in text:
            text = self._sub(STRIKE, "markdown", lambda m: m[1], text)
        if "*" in text or "_" in text:
            text = self._sub(EMPH, "markdown", lambda m: m[1] or m[2], text)
        return text

    def _blocks(self, text: str) -> None:
        stack, para = [self.root], []

        def flush() -> None:
            if para:
                body = self._inline(BLOCK_SIGNS.sub(" ", "\n".join(para))).strip()
                if body:
                    stack[-1].children.append(Node("paragraph", self.release(body)))
                para.clear()

        def add(kind: str, body: str, level: int = 0, raw: bool = False) -> None:
            flush()
            stack[-1].children.append(Node(kind, body if raw else self.release(self._inline(BLOCK_SIGNS.sub(" ", body))).strip(), level))

        lines = text.split("\n")
        i = -1
        while (i := i + 1) < len(lines):
            line = lines[i].rstrip()
            if not line.strip():
                flush()
                continue
            first = line.lstrip()[0]
            if first == "\ue002":
                add("code", self.release(BLOCK_SIGNS.sub(" ", line.lstrip()[1:])).strip(), raw=True)
            elif first == "\ue003":
                name = line.strip().strip("\ue003")
                flush()
                if not name.strip("/").isalnum():
                    continue
                if name[0] == "/":
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].kind == "<" + name[1:]:
                            del stack[k:]
                            break
                else:
                    if name == "li":
                        # The next item closes the one before it in the same list.
                        for k in range(len(stack) - 1, 0, -1):
                            if stack[k].kind == "<li":
                                del stack[k:]
                                break
                            if stack[k].kind not in ("<address", "<div", "<p"):
                                break
                    node = Node("<" + name)
                    stack[-1].children.append(node)
                    stack.append(node)
            elif first == "\ue004":
                add("row", " | ".join(c.strip() for c in line.lstrip()[1:].split("\ue004")))
            elif first == "\ue005":
                _, level, body = line.lstrip().split("\ue005", 2)
                add("heading", body, int(level))
            elif first == "\ue006":
                add("item", line.lstrip()[1:])
            elif first == "=" and (m := WIKI_HEAD.match(line)):
                self.families.add("wiki")
                add("heading", m[2], len(m[1]))
            elif first == "#" and (m := ATX.match(line)):
                self.families.add("markdown")
                add("heading", m[2], len(m[1]))
            elif first in "=-" and para and (m := SETEXT.match(line)):
                self.families.add("markdown")
                head = para.pop()
                flush()
                add("heading", head, 1 if m[1][0] == "=" else 2)
            elif first in "-*_" and RULE.match(line):
                self.families.add("markdown")
                flush()
            elif first == "|" and "-" in line and DELIMITER.match(line) and para and "|" in para[-1]:
                self.families.add("markdown")
                head = para.pop()
                flush()
                cells = lambda s: " | ".join(c.strip() for c in s.strip().strip("|").split("|"))
                add("row", cells(head))
                while i + 1 < len(lines) and "|" in lines[i + 1]:
                    i += 1
                    add("row", cells(lines[i]))
            elif first in "-*+0123456789" and (m := ITEM.match(line)) and self._listed(m, line, lines, i):
                self.families.add("markdown")
                add("item", m[2], len(m[1].replace("\t", "    ")) // 2)
            elif first == ">" and (m := QUOTE.match(line)):
                self.families.add("markdown")
                add("quote", m[1])
            elif first == "[" and (m := FOOTNOTE_DEF.match(line)):
                self.families.add("markdown")
                add("note", m[1])
            elif first == "[" and REF_DEF.match(line):
                self.families.add("markdown")
                flush()
            elif line.endswith("\\") and HARD_BREAK.search(line):
                self.families.add("markdown")
                para.append(line[:-1])
            else:
                para.append(line)
        flush()

    @staticmethod
    def _listed(m: re.Match, line: str, lines: list[str], i: int) -> bool:
        """A numbered line is an item if it is 1 or 2 or stands beside another; a year or amount at a line's start is not."""
        if not line.lstrip()[0].isdigit():
            return True
        number = int(re.match(r"\s*(\d+)", line)[1])
        near = [lines[k] for k in (i - 1, i + 1) if 0 <= k < len(lines)]
        return number in (0, 1) or any(re.match(r"\s*\d+[.)]\s", x) for x in near)


def _braces(text: str) -> tuple[dict[int, int], dict[int, int]]:
    """Where the brace that opens before a position closes: on its line, and within its paragraph."""
    line: dict[int, int] = {}
    part: dict[int, int] = {}
    on_line: list[int] = []
    in_part: list[int] = []
    blanks = [m.start() for m in BLANK_LINE.finditer(text)]
    for m in BRACES.finditer(text):
        if m[0] == "{":
            on_line.append(m.end())
            in_part.append(m.end())
        elif m[0] == "\n":
            on_line.clear()
            k = bisect_left(blanks, m.start())
            if k < len(blanks) and blanks[k] == m.start():
                in_part.clear()
        else:
            if on_line:
                line[on_line.pop()] = m.start()
            if in_part:
                part[in_part.pop()] = m.start()
    return line, part


def render(node: Node, drop: frozenset | set = frozenset()) -> str:
    """Clean text of a tree without the subtrees whose digests are in drop; any depth."""
    out: list[str] = []
    stack = [(c, 0) for c in reversed(node.children)]
    while stack:
        c, depth = stack.pop()
        if c.digest in drop:
            continue
        more, level = c.children if c.kind[0] == "<" else [], depth
        if c.kind == "heading":
            out.append("\u00a7" * max(1, c.level) + " " + c.text)
        elif c.kind == "item":
            out.append("  " * (c.level + depth) + "\u2022 " + c.text)
        elif c.kind == "code":
            out.append("\u300e\n" + c.text + "\n\u300f")
        elif HTML_HEAD.fullmatch(c.kind):
            text, more = _lead(c.children, drop)
            if text:
                out.append("\u00a7" * int(c.kind[2]) + " " + text)
        elif c.kind == "<li":
            text, more = _lead(c.children, drop)
            if text or more and more[0].kind not in ("<ul", "<ol"):
                out.append("  " * depth + ("\u2022 " + text).rstrip())
            level = depth + 1
        elif c.kind[0] != "<" and c.text:
            out.append(c.text)
        stack += [(x, level) for x in reversed(more)]
    return "\n".join(out)


def _lead(children: list[Node], drop: frozenset | set) -> tuple[str, list[Node]]:
    """The text with which a list item or heading begins, and the blocks after it, without what is in drop."""
    after: list[Node] = []
    while True:
        left = [c for c in children if c.digest not in drop]
        k = next((i for i, c in enumerate(left) if c.kind not in ("paragraph", "quote", "row", "note")), len(left))
        if k or not left or left[0].kind not in PLAIN:
            return " ".join(c.text for c in left[:k]), left[k:] + after
        after = left[1:] + after
        children = left[0].children


def subtrees(node: Node) -> Iterator[str]:
    for c in _below(node):
        yield c.digest


def blocks(node: Node) -> Iterator[str]:
    """Digests of the subtrees that are too much to recur by chance.

    Page furniture of HTML, other containers of three texts or BLOCK_CHARS
    characters, and single texts as long; no headings, code or formulas.
    """
    for c in _below(node):
        if c.kind in FURNITURE and c.texts or c.kind[0] == "<" and c.texts >= 3 or c.chars >= BLOCK_CHARS:
            yield c.digest


PARSED = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("families", "subtrees", "blocks")] + [T.StructField("clean", T.StringType())])


@F.pandas_udf(PARSED)
def parse_udf(texts: pd.Series) -> pd.DataFrame:
    """Families (in fixed order), distinct subtree hashes of each text, which of them are blocks, and the clean text of all; equal texts of a batch are parsed once."""
    codes, values = pd.factorize(texts, use_na_sentinel=False)
    got = []
    for v in values:
        p = Parse(v if isinstance(v, str) else None)
        got.append(([f for f in FAMILIES if f in p.families], list(dict.fromkeys(subtrees(p.root))), list(dict.fromkeys(blocks(p.root))), render(p.root)))
    return pd.DataFrame({f.name: [got[k][i] for k in codes] for i, f in enumerate(PARSED.fields)})


#: Declared nondeterministic so that the condition which an explode of the families brings does not parse every text twice.
parse_udf = parse_udf.asNondeterministic()


@F.pandas_udf(T.StringType())
def without_udf(texts: pd.Series, drop: pd.Series) -> pd.Series:
    """The clean text without the subtrees listed."""
    return pd.Series([render(Parse(t).root, frozenset(d)) for t, d in zip(texts, drop, strict=True)], dtype=object)


def parsed(df: DataFrame, key: Column, fields: list[str], host: Column, order: Column) -> DataFrame:
    """key, host, field, ord, text, families, subtrees, blocks, clean: one row for each given field with a text."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    long = df.select(key.alias("key"), host.alias("host"), order.alias("ord"), each.alias("x")).select("key", "host", "x.field", "ord", "x.text")
    return long.where("key is not null and text is not null and text <> ''").withColumn("p", parse_udf("text")).select("key", "host", "field", "ord", "text", "p.*")


def site_templates(parts: DataFrame, min_pages: int = 8, min_share: float = 0.4, block_share: float = 0.02) -> DataFrame:
    """host, drop: the subtree hashes that recur on min_share of the host's pages, and on min_pages at least.

    For blocks, which do not recur by chance, block_share is enough, so that
    the template of a part of a large host goes too.  A subtree counts once a
    page: the distinct (host, subtree, page) are reduced map side, then
    counted by (host, subtree), so one host may hold any share of all rows.  A
    host has at most (subtrees a page / block_share) template subtrees, so the
    array of a host stays small whatever the number of pages.
    """
    marked = F.transform("subtrees", lambda h: F.struct(h.alias("h"), F.array_contains("blocks", h).alias("block")))
    one = parts.select("host", "key", F.explode(marked).alias("x")).select("host", "key", "x.*").distinct()
    per = one.groupBy("host", "h", "block").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    pages = parts.groupBy("host").agg(F.count_distinct("key").alias("pages"))
    share = F.when(F.col("block"), min(block_share, min_share)).otherwise(min_share)
    return per.join(pages, "host").where(F.col("n") >= F.col("pages") * share).groupBy("host").agg(F.collect_set("h").alias("drop"))


def clean_pages(df: DataFrame, key: str, fields: list[str], host: Column, order: Column | None = None, min_pages: int = 8, min_share: float = 0.4, block_share: float = 0.02, splits: int = 16) -> DataFrame:
    """key, host, field, ord, families, removed (number of its template subtrees), clean: one row for each row of df and given field with a text.

    Each text is parsed once; only texts that hold a template of their host
    are parsed again, to be rendered without it.  ``families`` are those that
    the text as given holds: a template's markup is the text's too.  A null
    host is a host of its own; null and empty texts give no row; a text that is
    nothing but template gives an empty clean text.  The rows of a host are
    spread over so many splits, its template list being repeated for each.
    """
    parts = written(parsed(df, F.col(key), fields, F.coalesce(host, F.lit("")), F.lit(0) if order is None else order), "parsed")
    drop = site_templates(parts, min_pages, min_share, block_share)
    drop = drop.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    j = parts.withColumn("split", F.pmod(F.xxhash64("key", "field"), F.lit(splits)).cast("int")).join(drop, ["host", "split"], "left")
    mine = j.withColumn("drop", F.array_intersect("subtrees", F.coalesce("drop", F.array().cast("array<string>"))))
    cols = ["key", "host", "field", "ord", "families"]
    whole = mine.where("size(drop) = 0").select(*cols, F.lit(0).alias("removed"), "clean")
    part = mine.where("size(drop) > 0").select(*cols, F.size("drop").alias("removed"), without_udf("text", "drop").alias("clean"))
    return whole.unionByName(part)


def markup_found(df: DataFrame, key: str, fields: list[str], host: Column, **limits) -> DataFrame:
    """Distinct key, field, family of the markup that the cleaning met, removed templates included.  Repeated rows give one."""
    got = clean_pages(df, key, fields, host, **limits)
    return got.select(F.col("key").alias(key), "field", F.explode("families").alias("family")).distinct()


def clean_text(df: DataFrame, key: str, fields: list[str], host: Column, order: Column | None = None, **limits) -> DataFrame:
    """key, field, family list, clean text with the host's template subtrees deleted: one row a key and field.

    Of several rows of one key the one with the least ``order`` holds, nulls
    last, then the least clean text.
    """
    got = clean_pages(df, key, fields, host, order, **limits)
    return got.groupBy("key", "field").agg(F.min(F.struct(F.col("ord").isNull(), "ord", "clean", "families")).alias("r")).select(
        F.col("key").alias(key), "field", F.array_join("r.families", ",").alias("families"), F.col("r.clean").alias("clean")
    )
