"""Markup residue in texts: HTML, Markdown, wiki and LaTeX.

Method: a text becomes a tree.  The root stands for the page; elements that enclose others
(tags, environments, fences, tables, templates) are inner nodes, single marks are leaves.  Every
node has a cue, what it looks like, and a hidden state: content or markup.  Parent-child
potentials and cue potentials are counted on labelled pages; sum-product messages, upward and
then downward, give each node's marginal.  Nodes more likely markup than content are converted.

The labelled pages are made by :func:`labelled_pages`: prose with known markup and with known
look-alikes (prices, paths, comparison signs, file names, footnotes), ``PAGES`` of them, so the
model doesn't depend on the size of the data.

Null texts are kept as null and hold no markup.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the potentials are counted on.
PAGES = 4000
KINDS = ("html", "markdown", "wiki", "latex")
#: Element names of HTML.
_TAGS = frozenset(
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead title tr tt u ul var video".split()
)
_VOID = frozenset("br hr img input meta link col source frame p li td tr th dd dt option".split())

#: What may stand for markup; the first that matches at a place is taken.
_CUES = (
    ("html_comment", r"<!--"),
    ("html_tag", r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>"),
    ("html_entity", r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"),
    ("angle", r"<"),
    ("path", r"\b[A-Za-z]:\\[^\s]*"),
    ("latex_env", r"\\(?:begin|end)\{[A-Za-z]+\*?\}"),
    ("latex_display", r"\$\$|\\\[|\\\("),
    ("latex_math", r"(?<![\\$\w])\$(?=[^\s$])[^$\n]*?[^\s\\$]?\$(?!\d)"),
    ("dollar", r"\$"),
    ("latex_command", r"~?\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{(?:[^{}\n]|\{[^{}\n]*\})*\})*"),
    ("markdown_fence", r"^[ \t]{0,3}(?:```|~~~)[^\n]*$"),
    ("markdown_code", r"`[^`\n]+`"),
    ("wiki_link", r"\[\[[^\[\]\n]+\]\]"),
    ("markdown_link", r"!?\[[^\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|!?\[[^\]\n]+\]\[[^\]\n]*\]|^\[[^\]\n]+\]:[ \t]*\S+"),
    ("footnote", r"\[[0-9]{1,4}\]"),
    ("wiki_table", r"^[ \t]*(?:\{\|[^\n]*|\|\}[ \t]*$|\|-[^\n|]*$)"),
    ("wiki_template", r"\{\{"),
    ("brace", r"\{[^{}\n]*\}"),
    ("wiki_heading", r"^(={1,6})[ \t]*[^=\s](?:[^\n]*[^=\s])?[ \t]*\2[ \t]*$"),
    ("wiki_magic", r"__[A-Z]{3,}__"),
    ("wiki_quote", r"(?<!')'{2,5}(?=[^'\s])[^'\n]+(?<=\S)'{2,5}(?!')"),
    ("markdown_strong", r"\*\*(?=[^\s*])[^*\n]+?(?<=\S)\*\*|(?<!\w)__(?=[^\s_])[^\n]+?(?<=[^\s_])__(?!\w)"),
    ("markdown_emphasis", r"(?<![*\w\\])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![*\w])|(?<![\w\\])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?!\w)"),
    ("markdown_strike", r"~~(?=\S)[^~\n]+~~"),
    ("markdown_heading", r"^[ \t]{0,3}#{1,6}[ \t]+\S[^\n]*$"),
    ("markdown_setext", r"^[^\n|>#*=-][^\n]*\n(?:={3,}|-{3,})[ \t]*$"),
    ("markdown_table", r"^[ \t]*\|[^\n]*\|[ \t]*\n[ \t]*\|[ \t]*:?-{2,}[ \t|:-]*$(?:\n[ \t]*\|[^\n]*\|[ \t]*$)*"),
    ("markdown_quote", r"^[ \t]{0,3}>[ \t]?(?=\S)"),
    ("markdown_task", r"^[ \t]*(?:[-*+]|[0-9]{1,3}[.)])[ \t]+\[[ xX]\][ \t]"),
    ("markdown_bullet", r"^[ \t]*[*+][ \t]+(?=\S)"),
    ("number_item", r"^[ \t]*[0-9]{1,3}[.)][ \t]+(?=\S)"),
    ("dash_item", r"^[ \t]*[-–•][ \t]+(?=\S)"),
    ("wiki_indent", r"^[:;]+[ \t]?(?=\S)"),
    ("hash", r"#"),
    ("star", r"\*"),
    ("ampersand", r"&"),
)
_SCAN = re.compile("(" + "|".join(f"(?P<{n}>{p.replace(chr(92) + '2', '(?P=eq)').replace('^(={1,6})', '^(?P<eq>={1,6})')})" for n, p in _CUES) + ")", re.M)
#: Where a cue can begin: at a line's beginning or at one of these signs.
_NEXT = re.compile(r"^|[<&\\$`\[{'_*~#!]|\b[A-Za-z]:\\", re.M)
#: A text without any of these holds no cue that could be markup.
MAYBE = r"[<&\\$`\[{=_*~#|>]|''|(?m)^[ \t]*[+:;]|^-{3,}[ \t]*$"
#: Marks without a bound on their length: how they begin, and how they end.
_ENDS = {"<!--": "-->", "$$": "$$", "\\[": "\\]", "\\(": "\\)"}
_BRACES = re.compile(r"\{\{|\}\}")
_MATHY = re.compile(r"[\\^_={}<>+]|^[A-Za-z]$")


@dataclass
class Node:
    cue: str
    start: int
    end: int
    parent: int
    children: list[int] = field(default_factory=list)
    close: int = -1
    inner: tuple[int, int] | None = None

    @property
    def kind(self) -> str:
        k = self.cue.partition("_")[0]
        return k if k in KINDS else ""


def _refined(cue: str, text: str) -> str:
    if cue == "html_tag":
        name = re.match(r"</?([A-Za-z0-9]+)", text)[1].lower()
        return "html_tag" if name in _TAGS else "angle"
    if cue == "latex_math":
        return "latex_math" if _MATHY.search(text[1:-1].strip()) else "dollar"
    if cue == "latex_command":
        return "latex_braced" if "{" in text else "latex_command"
    return cue


def _end(text: str, cue: str, start: int, missing: set[str]) -> int:
    """Where the mark that begins at ``start`` ends, or -1.  ``missing``: ends that the rest of the text doesn't hold."""
    if cue == "wiki_template":
        depth = 0
        for m in () if "}}" in missing else _BRACES.finditer(text, start):
            depth += 1 if m[0] == "{{" else -1
            if not depth:
                return m.end() if m.end() - start > 4 else -1
        missing.add("}}")
        return -1
    begin = next(b for b in _ENDS if text.startswith(b, start))
    at = -1 if begin in missing else text.find(_ENDS[begin], start + len(begin))
    if at < 0:
        missing.add(begin)
        return -1
    return at + len(_ENDS[begin]) if at > start + len(begin) or begin == "<!--" else -1


def _inner(cue: str, raw: str) -> tuple[int, int] | None:
    """The part of a mark that is content and may hold marks of its own."""
    if cue == "markdown_heading":
        a = re.match(r"[ \t]*#+[ \t]+", raw).end()
        return a, max(a, len(re.sub(r"[ \t]+#+[ \t]*$", "", raw)))
    if cue == "markdown_setext":
        return 0, raw.index("\n")
    if cue in ("markdown_strong", "markdown_strike"):
        return 2, len(raw) - 2
    if cue == "markdown_emphasis":
        return 1, len(raw) - 1
    if cue == "wiki_quote":
        n = min(len(raw) - len(raw.lstrip("'")), len(raw) - len(raw.rstrip("'")))
        return n, len(raw) - n
    if cue == "wiki_heading":
        n = len(raw.rstrip()) - len(raw.rstrip().rstrip("="))
        return n, len(raw.rstrip()) - n
    if cue == "wiki_link":
        return max(2, raw.rfind("|") + 1), len(raw) - 2
    if cue == "markdown_link" and ("](" in raw or "][" in raw):
        return raw.index("[") + 1, raw.index("]")
    if cue == "latex_braced" and re.fullmatch(r"~?\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{(?:[^{}\n]|\{[^{}\n]*\})*\}", raw):
        return raw.index("{") + 1, len(raw) - 1
    if cue in ("markdown_table", "wiki_template"):
        return 2, len(raw) - 2
    return None


def tree(text: str) -> list[Node]:
    """Nodes of ``text`` in order; node 0 is the page.  Enclosing elements own what lies between their ends."""
    nodes = [Node("page", 0, len(text), -1)]
    stack = [0]
    names: list[str] = [""]
    fence = ""
    pos = 0
    missing: set[str] = set()
    bounds: list[tuple[int, int]] = []  # marks that the place is inside of: end, depth of the stack outside
    while pos < len(text) and (at := _NEXT.search(text, pos)):
        while bounds and at.start() >= bounds[-1][0]:
            _, depth = bounds.pop()
            del stack[depth:], names[depth:]
        m = _SCAN.match(text, at.start(), bounds[-1][0] if bounds else len(text))
        if not m or m.end() < pos:
            pos = at.start() + 1
            continue
        cue = m.lastgroup if m.lastgroup != "eq" else "wiki_heading"
        cue = next(n for n, _ in _CUES if m.group(n) is not None) if cue is None else cue
        end = m.end()
        if cue in ("html_comment", "latex_display", "wiki_template") and not fence:
            end = _end(text, cue, m.start(), missing)
            if end < 0 or (bounds and end > bounds[-1][0]):
                pos = m.start() + len(m.group(0))
                continue
        raw = text[m.start() : end]
        pos = end if end > m.start() else end + 1
        if fence:
            # nothing but the fence's end counts within program text
            if cue == "markdown_fence" and raw.strip()[:3] == fence:
                nodes[stack[-1]].close = m.end()
                stack.pop()
                names.pop()
                fence = ""
            continue
        cue = _refined(cue, raw)
        if cue == "angle" and len(raw) > 1:
            pos = m.start() + 1
            nodes.append(Node(cue, m.start(), m.start() + 1, stack[-1]))
            nodes[stack[-1]].children.append(len(nodes) - 1)
            continue
        opens = closes = ""
        if cue == "html_tag":
            name = re.match(r"</?([A-Za-z0-9]+)", raw)[1].lower()
            if raw[1] == "/":
                closes = name
            elif name not in _VOID and not raw.endswith("/>"):
                opens = name
        elif cue == "latex_env":
            name = "env:" + raw[raw.index("{") + 1 : -1]
            opens, closes = (name, "") if raw.startswith("\\begin") else ("", name)
        elif cue == "markdown_fence":
            opens = fence = raw.strip()[:3]
        elif cue == "wiki_table":
            opens, closes = ("{|", "") if raw.lstrip().startswith("{|") else ("", "{|" if raw.strip() == "|}" else "")
        nodes.append(Node(cue, m.start(), end, stack[-1]))
        i = len(nodes) - 1
        if content := _inner(cue, raw):
            nodes[i].inner = m.start() + content[0], m.start() + content[1]
            nodes[stack[-1]].children.append(i)
            bounds.append((nodes[i].inner[1], len(stack)))
            stack.append(i)
            names.append("")
            pos = max(nodes[i].inner[0], m.start() + 1)
            continue
        if closes and closes in names:
            while names[-1] != closes:
                stack.pop()
                names.pop()
            nodes[stack[-1]].close = m.end()
            nodes[i].parent = stack[-1]
            nodes[stack[-1]].children.append(i)
            stack.pop()
            names.pop()
            continue
        nodes[stack[-1]].children.append(i)
        if opens:
            stack.append(i)
            names.append(opens)
    return nodes


class Model:
    """Log potentials: of a cue with a state, and of a child's state with its parent's."""

    def __init__(self, pages: list[tuple[list[Node], list[int]]]):
        cues = {n for n, _ in _CUES} | {"page", "latex_braced"}
        seen = {c: [0.1, 0.1] for c in cues}
        edge = [[1.0, 1.0], [1.0, 1.0]]
        states = [1.0, 1.0]
        for nodes, labels in pages:
            for n, y in zip(nodes, labels):
                seen[n.cue][y] += 1
                states[y] += 1
                if n.parent >= 0:
                    edge[labels[n.parent]][y] += 1
        total = [sum(v[y] for v in seen.values()) for y in (0, 1)]
        self.node = {c: [math.log(v[y] / total[y]) for y in (0, 1)] for c, v in seen.items()}
        self.edge = [[math.log(edge[p][c] / sum(edge[p])) for c in (0, 1)] for p in (0, 1)]
        self.root = [math.log(s / sum(states)) for s in states]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(markup) of every node: sum-product over the tree, leaves to root and back."""
        n = len(nodes)
        up = [[0.0, 0.0] for _ in range(n)]  # product of what a node's children say, and its own cue
        sent = [[0.0, 0.0] for _ in range(n)]  # what a node says to its parent
        for i in range(n - 1, -1, -1):
            own = self.node[nodes[i].cue]
            b = up[i]
            b[0] += own[0]
            b[1] += own[1]
            p = nodes[i].parent
            if p >= 0:
                e = self.edge
                sent[i] = [_add(e[0][0] + b[0], e[0][1] + b[1]), _add(e[1][0] + b[0], e[1][1] + b[1])]
                up[p][0] += sent[i][0]
                up[p][1] += sent[i][1]
        down = [[0.0, 0.0] for _ in range(n)]
        down[0] = list(self.root)
        out = [0.0] * n
        for i in range(n):
            a, b = up[i][0] + down[i][0], up[i][1] + down[i][1]
            out[i] = 1 / (1 + math.exp(max(-700, min(700, a - b))))
            for c in nodes[i].children:
                rest = (a - sent[c][0], b - sent[c][1])
                down[c] = [_add(self.edge[0][s] + rest[0], self.edge[1][s] + rest[1]) for s in (0, 1)]
        return out


def _add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def labelled_pages(n: int = PAGES, seed: int = 5) -> list[tuple[list[Node], list[int]]]:
    """Pages of prose with marks and look-alikes whose nature is known, as (nodes, state of each node)."""
    rng = random.Random(seed)
    w = lambda: rng.choice("report table office copy letter series notice region answer column margin person".split())
    num = lambda: rng.randint(1, 99)
    marks = {
        "html": ("<p>{a} {b}</p>", "<br>", "{a}&nbsp;{b}", "<b>{a}</b>", "<ul>\n<li>{a}</li>\n<li>{b}\n</ul>", "<!-- {a} -->", "<div class=\"{a}\"><a href=\"/{b}\">{a}</a></div>", "<h2>{a}</h2>", "<table><tr><td>{n}</td></tr></table>", "&amp; {a}", "<pre><code>{a}</code></pre>"),
        "markdown": ("# {a}", "## {a} {b}", "{A}\n=====", "**{a}** {b}", "__{a}__ {b}", "*{a}* {b}", "_{a}_ {b}", "~~{a}~~", "[{a}]({b}.md)", "![{a}]({b}.png)", "`{a}_{n}`", "```\n{a} = {n}\n```", "~~~\n{a}\n~~~", "| {a} | {b} |\n|---|---|\n| {n} | {n} |", "> {a} {b}", "* {a}\n* {b}", "+ {a}\n+ {b}", "1. [x] {a}\n2. [ ] {b}", "- [ ] {a}"),
        "wiki": ("== {a} ==", "=== {a} {b} ===", "''{a}'' {b}", "'''{a}'''", "[[{a}]]", "[[{a}|{b}]]", "[[Category:{a}]]", "{{{{{a}}}}}", "{{{{Infobox {a}\n| size = {n}\n}}}}", "{{| class=\"wikitable\"\n! {a}\n|-\n| {n}\n|}}", "__NOTOC__", "== {a} ==\n:{b}"),
        "latex": ("\\section{{{a}}}", "\\textbf{{{a}}} {b}", "\\begin{{itemize}}\n\\item {a}\n\\end{{itemize}}", "$x_{{{n}}} = y^2$", "\\[ \\sqrt{{{n}}} \\leq \\lambda \\]", "\\(\\alpha < {n}\\)", "$$ \\int_0^{n} f(t)\\,dt $$", "{a}~\\ref{{fig:{b}}}", "\\footnote{{{a}}}", "\\begin{{tabular}}{{lr}}\n{a} & {n} \\\\\n\\end{{tabular}}", "\\alpha", "\\item {a}"),
    }
    plain = ("It cost ${n} to ${n}0 per {a}.", "The folder D:\\{a}\\{b}\\file is full.", "Values {n} < {n} and b > {n}.", "a<b<c", "x <- y", "The share for R&D and A&B.", "Room #{n}", "{a}_{b}_v{n}.txt", "See [{n}].", "{n} * {n} * {n} units", "The field {{{a}}} is empty.", "- {a}\n- {b}", "{n}. {A}", "{n}. {a} {b}", "A list: - {a} - {b}.", "def {a}_{b}(x): return {n} & 3", "* {n}")
    pages = []
    for _ in range(n):
        parts: list[tuple[str, bool]] = []
        kinds = rng.sample(KINDS, rng.choice((0, 1, 1, 1, 2)))
        for _ in range(rng.randint(2, 9)):
            parts.append((" ".join(w() for _ in range(rng.randint(4, 12))) + ".", False))
            if kinds and rng.random() < 0.6:
                parts.append((rng.choice(marks[rng.choice(kinds)]).format(a=w(), b=w(), n=num(), A=w().title()), True))
            if rng.random() < 0.25:
                parts.append((rng.choice(plain).format(a=w(), b=w(), n=num(), A=w().title()), False))
        text, spans = "", []
        for s, mark in parts:
            if text:
                text += "\n" if mark and s[0] in "#=>*+|{`~_1-[" or "\n" in s else rng.choice((" ", "\n", "\n\n"))
            spans.append((len(text), len(text) + len(s), mark))
            text += s
            if mark and ("\n" in s or s[0] in "#=>*+|"):
                text += "\n"
        nodes = tree(text)
        labels = [int(any(m for *_, m in spans))] + [int(any(a <= x.start < b and m for a, b, m in spans)) for x in nodes[1:]]
        pages.append((nodes, labels))
    return pages


_model: Model | None = None


def model() -> Model:
    global _model
    if _model is None:
        _model = Model(labelled_pages())
    return _model


def use(trained: Model) -> None:
    """Makes ``trained`` the model of this process, instead of training one."""
    global _model
    _model = trained


def marked(text: str | None) -> list[tuple[Node, float]]:
    """The nodes of ``text`` that are more likely markup than content."""
    if not text:
        return []
    nodes = tree(text)
    if len(nodes) == 1:
        return []
    p = model().marginals(nodes)
    return [(x, q) for x, q in zip(nodes[1:], p[1:]) if q > 0.5 and x.kind]


def kinds(text: str | None) -> list[str]:
    found = {x.kind for x, _ in marked(text)}
    return [k for k in KINDS if k in found]


_GREEK = re.compile(r"\\([A-Za-z]+)\*?")


def clean(text: str | None) -> str | None:
    """``text`` without markup.  Headings become lines that begin with "# ", list items with "- " or their number, program
    text is indented by four blanks, formulas stand between "⟦" and "⟧", cells of tables are parted by tabs."""
    if not text:
        return text
    nodes = tree(text)
    if len(nodes) == 1:
        return text
    p = model().marginals(nodes)
    marks = [q > 0.5 and bool(x.kind) for x, q in zip(nodes, p)]
    if not any(marks):
        return text
    joined = re.sub(r"[ \t]+\n", "\n", _rendered(text, nodes, marks, 1, 0, len(text))[0])
    return re.sub(r"\n{3,}", "\n\n", joined).strip("\n")


def _rendered(text: str, nodes: list[Node], marks: list[bool], i: int, low: int, high: int) -> tuple[str, int]:
    """``text`` between two places without its marks, and the first node behind it; ``i``: its first node."""
    out, pos = [], low
    while i < len(nodes) and nodes[i].start < high:
        x = nodes[i]
        if x.start < pos:
            i += 1
            continue
        out.append(text[pos : x.start])
        raw = text[x.start : x.end]
        whole = marks[i] and x.close > 0 and (x.cue in ("markdown_fence", "wiki_table") or (x.cue == "html_tag" and re.match(r"<(?:script|style)\b", raw, re.I)))
        if whole:
            out.append(_block(x.cue, text[x.start : x.close]))
            pos = x.close
            i += 1
        elif x.inner and (x.cue not in ("wiki_template", "markdown_table") or not marks[i]):
            content, j = _rendered(text, nodes, marks, i + 1, *x.inner)
            out.append(_plain(x.cue, raw[: x.inner[0] - x.start] + content + raw[x.inner[1] - x.start :], content) if marks[i] else text[x.start : x.inner[0]] + content + text[x.inner[1] : x.end])
            pos, i = x.end, j
        else:
            out.append(_plain(x.cue, raw) if marks[i] else raw)
            pos = x.end
            i += 1
    out.append(text[pos:high])
    return "".join(out), i


def _block(cue: str, raw: str) -> str:
    """Elements that are rendered with all they hold."""
    if cue == "markdown_fence":
        return "\n".join("    " + line for line in raw.split("\n")[1:-1])
    if cue == "html_tag":
        return ""
    rows: list[list[str]] = [[]]
    for line in map(str.strip, raw.split("\n")[1:-1]):
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            rows[-1].append(clean(line[2:].strip()))
            rows.append([])
        elif line[:1] in ("|", "!"):
            rows[-1] += [clean(re.sub(r"^[^|\[{]*=[^|\[{]*\|(?!\|)", "", c).strip()) for c in re.split(r"\|\||!!", line[1:])]
        elif line and rows[-1]:
            rows[-1][-1] += " " + clean(line)
        elif line:
            rows[-1].append(clean(line))
    return "\n".join("\t".join(r) for r in rows if r)


def _plain(cue: str, s: str, content: str | None = None) -> str:
    """What stands for a mark; ``content``: its inner part, already without marks."""
    if cue == "html_entity":
        return html.unescape(s).replace("\xa0", " ")
    if cue == "html_tag":
        name = re.match(r"</?([A-Za-z0-9]+)", s)[1].lower()
        closing = s[1] == "/"
        if re.fullmatch("h[1-6]", name):
            return "\n" if closing else "\n# "
        if name == "li":
            return "" if closing else "\n- "
        if name in ("td", "th"):
            return "" if closing else "\t"
        if name == "pre":
            return "\n" if closing else "\n    "
        return "\n" if name in ("p", "br", "div", "tr", "ul", "ol", "table", "hr", "section", "article", "blockquote") else ""
    if cue in ("html_comment", "wiki_magic", "wiki_table", "latex_env"):
        if cue == "latex_env" and "equation" in s:
            return "⟦" if s.startswith("\\begin") else "⟧"
        return ""
    if cue in ("latex_display", "latex_math"):
        return "⟦" + re.sub(r"^(?:\$\$?|\\\[|\\\()\s*|\s*(?:\$\$?|\\\]|\\\))$", "", s) + "⟧"
    if cue in ("latex_command", "latex_braced"):
        name = re.match(r"~?\\([A-Za-z]+)", s)[1]
        inner = [content] if content is not None else re.findall(r"\{((?:[^{}]|\{[^{}]*\})*)\}", s)
        if "section" in name or name in ("chapter", "title", "paragraph"):
            return "\n# " + (inner[0] if inner else "")
        if name == "item":
            return "- "
        if name in ("ref", "label", "cite", "hline", "pageref", "usepackage", "documentclass"):
            return ""
        if name == "frac" and len(inner) == 2:
            return f"{inner[0]}/{inner[1]}"
        return (" (" + inner[0] + ")" if name == "footnote" else inner[0]) if inner else _GREEK.sub(r"\1", s)
    if cue == "wiki_link":
        return "" if re.match(r"(?i)\[\[category:", s) else content
    if cue == "markdown_link":
        return content or ""
    if cue == "wiki_template":
        depth = 0
        for m in () if "}}" in missing else _BRACES.finditer(text, start):
            depth += 1 if m[0] == "{{" else -1
            if not depth:
                return m.end() if m.end() - start > 4 else -1
        missing.add("}}")
        return -1
    begin = next(b for b in _ENDS if text.startswith(b, start))
    at = -1 if begin in missing else text.find(_ENDS[begin], start + len(begin))
    if at < 0:
        missing.add(begin)
        return -1
    return at + len(_ENDS[begin]) if at > start + len(begin) or begin == "<!--" else -1


def _inner(cue: str, raw: str) -> tuple[int, int] | None:
    """The part of a mark that is content and may hold marks of its own."""
    if cue == "markdown_heading":
        a = re.match(r"[ \t]*#+[ \t]+", raw).end()
        return a, max(a, len(re.sub(r"[ \t]+#+[ \t]*$", "", raw)))
    if cue == "markdown_setext":
        return 0, raw.index("\n")
    if cue in ("markdown_strong", "markdown_strike"):
        return 2, len(raw) - 2
    if cue == "markdown_emphasis":
        return 1, len(raw) - 1
    if cue == "wiki_quote":
        n = min(len(raw) - len(raw.lstrip("'")), len(raw) - len(raw.rstrip("'")))
        return n, len(raw) - n
    if cue == "wiki_heading":
        n = len(raw.rstrip()) - len(raw.rstrip().rstrip("="))
        return n, len(raw.rstrip()) - n
    if cue == "wiki_link":
        return max(2, raw.rfind("|") + 1), len(raw) - 2
    if cue == "markdown_link" and ("](" in raw or "][" in raw):
        return raw.index("[") + 1, raw.index("]")
    if cue == "latex_braced" and re.fullmatch(r"~?\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{(?:[^{}\n]|\{[^{}\n]*\})*\}", raw):
        return raw.index("{") + 1, len(raw) - 1
    if cue in ("markdown_table", "wiki_template"):
        return 2, len(raw) - 2
    return None


def tree(text: str) -> list[Node]:
    """Nodes of ``text`` in order; node 0 is the page.  Enclosing elements own what lies between their ends."""
    nodes = [Node("page", 0, len(text), -1)]
    stack = [0]
    names: list[str] = [""]
    fence = ""
    pos = 0
    missing: set[str] = set()
    bounds: list[tuple[int, int]] = []  # marks that the place is inside of: end, depth of the stack outside
    while pos < len(text) and (at := _NEXT.search(text, pos)):
        while bounds and at.start() >= bounds[-1][0]:
            _, depth = bounds.pop()
            del stack[depth:], names[depth:]
        m = _SCAN.match(text, at.start(), bounds[-1][0] if bounds else len(text))
        if not m or m.end() < pos:
            pos = at.start() + 1
            continue
        cue = m.lastgroup if m.lastgroup != "eq" else "wiki_heading"
        cue = next(n for n, _ in _CUES if m.group(n) is not None) if cue is None else cue
        end = m.end()
        if cue in ("html_comment", "latex_display", "wiki_template") and not fence:
            end = _end(text, cue, m.start(), missing)
            if end < 0 or (bounds and end > bounds[-1][0]):
                pos = m.start() + len(m.group(0))
                continue
        raw = text[m.start() : end]
        pos = end if end > m.start() else end + 1
        if fence:
            # nothing but the fence's end counts within program text
            if cue == "markdown_fence" and raw.strip()[:3] == fence:
                nodes[stack[-1]].close = m.end()
                stack.pop()
                names.pop()
                fence = ""
            continue
        cue = _refined(cue, raw)
        if cue == "angle" and len(raw) > 1:
            pos = m.start() + 1
            nodes.append(Node(cue, m.start(), m.start() + 1, stack[-1]))
            nodes[stack[-1]].children.append(len(nodes) - 1)
            continue
        opens = closes = ""
        if cue == "html_tag":
            name = re.match(r"</?([A-Za-z0-9]+)", raw)[1].lower()
            if raw[1] == "/":
                closes = name
            elif name not in _VOID and not raw.endswith("/>"):
                opens = name
        elif cue == "latex_env":
            name = "env:" + raw[raw.index("{") + 1 : -1]
            opens, closes = (name, "") if raw.startswith("\\begin") else ("", name)
        elif cue == "markdown_fence":
            opens = fence = raw.strip()[:3]
        elif cue == "wiki_table":
            opens, closes = ("{|", "") if raw.lstrip().startswith("{|") else ("", "{|" if raw.strip() == "|}" else "")
        nodes.append(Node(cue, m.start(), end, stack[-1]))
        i = len(nodes) - 1
        if content := _inner(cue, raw):
            nodes[i].inner = m.start() + content[0], m.start() + content[1]
            nodes[stack[-1]].children.append(i)
            bounds.append((nodes[i].inner[1], len(stack)))
            stack.append(i)
            names.append("")
            pos = max(nodes[i].inner[0], m.start() + 1)
            continue
        if closes and closes in names:
            while names[-1] != closes:
                stack.pop()
                names.pop()
            nodes[stack[-1]].close = m.end()
            nodes[i].parent = stack[-1]
            nodes[stack[-1]].children.append(i)
            stack.pop()
            names.pop()
            continue
        nodes[stack[-1]].children.append(i)
        if opens:
            stack.append(i)
            names.append(opens)
    return nodes


class Model:
    """Log potentials: of a cue with a state, and of a child's state with its parent's."""

    def __init__(self, pages: list[tuple[list[Node], list[int]]]):
        cues = {n for n, _ in _CUES} | {"page", "latex_braced"}
        seen = {c: [0.1, 0.1] for c in cues}
        edge = [[1.0, 1.0], [1.0, 1.0]]
        states = [1.0, 1.0]
        for nodes, labels in pages:
            for n, y in zip(nodes, labels):
                seen[n.cue][y] += 1
                states[y] += 1
                if n.parent >= 0:
                    edge[labels[n.parent]][y] += 1
        total = [sum(v[y] for v in seen.values()) for y in (0, 1)]
        self.node = {c: [math.log(v[y] / total[y]) for y in (0, 1)] for c, v in seen.items()}
        self.edge = [[math.log(edge[p][c] / sum(edge[p])) for c in (0, 1)] for p in (0, 1)]
        self.root = [math.log(s / sum(states)) for s in states]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(markup) of every node: sum-product over the tree, leaves to root and back."""
        n = len(nodes)
        up = [[0.0, 0.0] for _ in range(n)]  # product of what a node's children say, and its own cue
        sent = [[0.0, 0.0] for _ in range(n)]  # what a node says to its parent
        for i in range(n - 1, -1, -1):
            own = self.node[nodes[i].cue]
            b = up[i]
            b[0] += own[0]
            b[1] += own[1]
            p = nodes[i].parent
            if p >= 0:
                e = self.edge
                sent[i] = [_add(e[0][0] + b[0], e[0][1] + b[1]), _add(e[1][0] + b[0], e[1][1] + b[1])]
                up[p][0] += sent[i][0]
                up[p][1] += sent[i][1]
        down = [[0.0, 0.0] for _ in range(n)]
        down[0] = list(self.root)
        out = [0.0] * n
        for i in range(n):
            a, b = up[i][0] + down[i][0], up[i][1] + down[i][1]
            out[i] = 1 / (1 + math.exp(max(-700, min(700, a - b))))
            for c in nodes[i].children:
                rest = (a - sent[c][0], b - sent[c][1])
                down[c] = [_add(self.edge[0][s] + rest[0], self.edge[1][s] + rest[1]) for s in (0, 1)]
        return out


def _add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def labelled_pages(n: int = PAGES, seed: int = 5) -> list[tuple[list[Node], list[int]]]:
    """Pages of prose with marks and look-alikes whose nature is known, as (nodes, state of each node)."""
    rng = random.Random(seed)
    w = lambda: rng.choice("report table office copy letter series notice region answer column margin person".split())
    num = lambda: rng.randint(1, 99)
    marks = {
        "html": ("<p>{a} {b}</p>", "<br>", "{a}&nbsp;{b}", "<b>{a}</b>", "<ul>\n<li>{a}</li>\n<li>{b}\n</ul>", "<!-- {a} -->", "<div class=\"{a}\"><a href=\"/{b}\">{a}</a></div>", "<h2>{a}</h2>", "<table><tr><td>{n}</td></tr></table>", "&amp; {a}", "<pre><code>{a}</code></pre>"),
        "markdown": ("# {a}", "## {a} {b}", "{A}\n=====", "**{a}** {b}", "__{a}__ {b}", "*{a}* {b}", "_{a}_ {b}", "~~{a}~~", "[{a}]({b}.md)", "![{a}]({b}.png)", "`{a}_{n}`", "```\n{a} = {n}\n```", "~~~\n{a}\n~~~", "| {a} | {b} |\n|---|---|\n| {n} | {n} |", "> {a} {b}", "* {a}\n* {b}", "+ {a}\n+ {b}", "1. [x] {a}\n2. [ ] {b}", "- [ ] {a}"),
        "wiki": ("== {a} ==", "=== {a} {b} ===", "''{a}'' {b}", "'''{a}'''", "[[{a}]]", "[[{a}|{b}]]", "[[Category:{a}]]", "{{{{{a}}}}}", "{{{{Infobox {a}\n| size = {n}\n}}}}", "{{| class=\"wikitable\"\n! {a}\n|-\n| {n}\n|}}", "__NOTOC__", "== {a} ==\n:{b}"),
        "latex": ("\\section{{{a}}}", "\\textbf{{{a}}} {b}", "\\begin{{itemize}}\n\\item {a}\n\\end{{itemize}}", "$x_{{{n}}} = y^2$", "\\[ \\sqrt{{{n}}} \\leq \\lambda \\]", "\\(\\alpha < {n}\\)", "$$ \\int_0^{n} f(t)\\,dt $$", "{a}~\\ref{{fig:{b}}}", "\\footnote{{{a}}}", "\\begin{{tabular}}{{lr}}\n{a} & {n} \\\\\n\\end{{tabular}}", "\\alpha", "\\item {a}"),
    }
    plain = ("It cost ${n} to ${n}0 per {a}.", "The folder D:\\{a}\\{b}\\file is full.", "Values {n} < {n} and b > {n}.", "a<b<c", "x <- y", "The share for R&D and A&B.", "Room #{n}", "{a}_{b}_v{n}.txt", "See [{n}].", "{n} * {n} * {n} units", "The field {{{a}}} is empty.", "- {a}\n- {b}", "{n}. {A}", "{n}. {a} {b}", "A list: - {a} - {b}.", "def {a}_{b}(x): return {n} & 3", "* {n}")
    pages = []
    for _ in range(n):
        parts: list[tuple[str, bool]] = []
        kinds = rng.sample(KINDS, rng.choice((0, 1, 1, 1, 2)))
        for _ in range(rng.randint(2, 9)):
            parts.append((" ".join(w() for _ in range(rng.randint(4, 12))) + ".", False))
            if kinds and rng.random() < 0.6:
                parts.append((rng.choice(marks[rng.choice(kinds)]).format(a=w(), b=w(), n=num(), A=w().title()), True))
            if rng.random() < 0.25:
                parts.append((rng.choice(plain).format(a=w(), b=w(), n=num(), A=w().title()), False))
        text, spans = "", []
        for s, mark in parts:
            if text:
                text += "\n" if mark and s[0] in "#=>*+|{`~_1-[" or "\n" in s else rng.choice((" ", "\n", "\n\n"))
            spans.append((len(text), len(text) + len(s), mark))
            text += s
            if mark and ("\n" in s or s[0] in "#=>*+|"):
                text += "\n"
        nodes = tree(text)
        labels = [int(any(m for *_, m in spans))] + [int(any(a <= x.start < b and m for a, b, m in spans)) for x in nodes[1:]]
        pages.append((nodes, labels))
    return pages


_model: Model | None = None


def model() -> Model:
    global _model
    if _model is None:
        _model = Model(labelled_pages())
    return _model


def use(trained: Model) -> None:
    """Makes ``trained`` the model of this process, instead of training one."""
    global _model
    _model = trained


def marked(text: str | None) -> list[tuple[Node, float]]:
    """The nodes of ``text`` that are more likely markup than content."""
    if not text:
        return []
    nodes = tree(text)
    if len(nodes) == 1:
        return []
    p = model().marginals(nodes)
    return [(x, q) for x, q in zip(nodes[1:], p[1:]) if q > 0.5 and x.kind]


def kinds(text: str | None) -> list[str]:
    found = {x.kind for x, _ in marked(text)}
    return [k for k in KINDS if k in found]


_GREEK = re.compile(r"\\([A-Za-z]+)\*?")


def clean(text: str | None) -> str | None:
    """``text`` without markup.  Headings become lines that begin with "# ", list items with "- " or their number, program
    text is indented by four blanks, formulas stand between "⟦" and "⟧", cells of tables are parted by tabs."""
    if not text:
        return text
    nodes = tree(text)
    if len(nodes) == 1:
        return text
    p = model().marginals(nodes)
    marks = [q > 0.5 and bool(x.kind) for x, q in zip(nodes, p)]
    if not any(marks):
        return text
    joined = re.sub(r"[ \t]+\n", "\n", _rendered(text, nodes, marks, 1, 0, len(text))[0])
    return re.sub(r"\n{3,}", "\n\n", joined).strip("\n")


def _rendered(text: str, nodes: list[Node], marks: list[bool], i: int, low: int, high: int) -> tuple[str, int]:
    """``text`` between two places without its marks, and the first node behind it; ``i``: its first node."""
    out, pos = [], low
    while i < len(nodes) and nodes[i].start < high:
        x = nodes[i]
        if x.start < pos:
            i += 1
            continue
        out.append(text[pos : x.start])
        raw = text[x.start : x.end]
        whole = marks[i] and x.close > 0 and (x.cue in ("markdown_fence", "wiki_table") or (x.cue == "html_tag" and re.match(r"<(?:script|style)\b", raw, re.I)))
        if whole:
            out.append(_block(x.cue, text[x.start : x.close]))
            pos = x.close
            i += 1
        elif x.inner and (x.cue not in ("wiki_template", "markdown_table") or not marks[i]):
            content, j = _rendered(text, nodes, marks, i + 1, *x.inner)
            out.append(_plain(x.cue, raw[: x.inner[0] - x.start] + content + raw[x.inner[1] - x.start :], content) if marks[i] else text[x.start : x.inner[0]] + content + text[x.inner[1] : x.end])
            pos, i = x.end, j
        else:
            out.append(_plain(x.cue, raw) if marks[i] else raw)
            pos = x.end
            i += 1
    out.append(text[pos:high])
    return "".join(out), i


def _block(cue: str, raw: str) -> str:
    """Elements that are rendered with all they hold."""
    if cue == "markdown_fence":
        return "\n".join("    " + line for line in raw.split("\n")[1:-1])
    if cue == "html_tag":
        return ""
    rows: list[list[str]] = [[]]
    for line in map(str.strip, raw.split("\n")[1:-1]):
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            rows[-1].append(clean(line[2:].strip()))
            rows.append([])
        elif line[:1] in ("|", "!"):
            rows[-1] += [clean(re.sub(r"^[^|\[{]*=[^|\[{]*\|(?!\|)", "", c).strip()) for c in re.split(r"\|\||!!", line[1:])]
        elif line and rows[-1]:
            rows[-1][-1] += " " + clean(line)
        elif line:
            rows[-1].append(clean(line))
    return "\n".join("\t".join(r) for r in rows if r)


def _plain(cue: str, s: str, content: str | None = None) -> str:
    """What stands for a mark; ``content``: its inner part, already without marks."""
    if cue == "html_entity":
        return html.unescape(s).replace("\xa0", " ")
    if cue == "html_tag":
        name = re.match(r"</?([A-Za-z0-9]+)", s)[1].lower()
        closing = s[1] == "/"
        if re.fullmatch("h[1-6]", name):
            return "\n" if closing else "\n# "
        if name == "li":
            return "" if closing else "\n- "
        if name in ("td", "th"):
            return "" if closing else "\t"
        if name == "pre":
            return "\n" if closing else "\n    "
        return "\n" if name in ("p", "br", "div", "tr", "ul", "ol", "table", "hr", "section", "article", "blockquote") else ""
    if cue in ("html_comment", "wiki_magic", "wiki_table", "latex_env"):
        if cue == "latex_env" and "equation" in s:
            return "⟦" if s.startswith("\\begin") else "⟧"
        return ""
    if cue in ("latex_display", "latex_math"):
        return "⟦" + re.sub(r"^(?:\$\$?|\\\[|\\\()\s*|\s*(?:\$\$?|\\\]|\\\))$", "", s) + "⟧"
    if cue in ("latex_command", "latex_braced"):
        name = re.match(r"~?\\([A-Za-z]+)", s)[1]
        inner = [content] if content is not None else re.findall(r"\{((?:[^{}]|\{[^{}]*\})*)\}", s)
        if "section" in name or name in ("chapter", "title", "paragraph"):
            return "\n# " + (inner[0] if inner else "")
        if name == "item":
            return "- "
        if name in ("ref", "label", "cite", "hline", "pageref", "usepackage", "documentclass"):
            return ""
        if name == "frac" and len(inner) == 2:
            return f"{inner[0]}/{inner[1]}"
        return (" (" + inner[0] + ")" if name == "footnote" else inner[0]) if inner else _GREEK.sub(r"\1", s)
    if cue == "wiki_link":
        body = s[2:-2]
        return "" if re.match(r"(?i)category:", body) else body.split("|")[-1]
    if cue == "markdown_link":
        m = re.match(r"!?\[([^\]]*)\]", s)
        return m[1] if "](" in s or "][" in s else ""
    if cue == "wiki_template":
        body = s[2:-2].split("|")
        return "; ".join(p.strip() for p in body[1:] if "=" in p)
    if cue in ("wiki_heading", "markdown_heading", "markdown_setext"):
        return "# " + content.strip()
    if cue in ("wiki_quote", "markdown_strong", "markdown_emphasis", "markdown_strike"):
        return content
    if cue == "wiki_indent":
        return ""
    if cue == "markdown_fence":
        return ""
    if cue == "markdown_code":
        return s[1:-1]
    if cue == "markdown_table":
        rows = [line.strip().strip("|").split("|") for i, line in enumerate(s.split("\n")) if i != 1]
        return "\n".join("\t".join(clean(c.strip()) for c in r) for r in rows)
    if cue == "markdown_quote":
        return ""
    if cue == "markdown_task" and (number := re.match(r"[ \t]*([0-9]+[.)])", s)):
        return number[1] + " "
    if cue in ("markdown_bullet", "markdown_task"):
        return "- "
    return s


def kinds_of(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, markup): each kind of markup of each text, once."""
    kind = dict(rows.dtypes)[id_col]

    trained = model()

    def run(batches) -> Iterator[pa.RecordBatch]:
        use(trained)
        for b in batches:
            at, said = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k in kinds(t):
                    at.append(i)
                    said.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(said, pa.string())], ["id", "markup"])

    maybe = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(MAYBE))
    return maybe.mapInArrow(run, f"id {kind}, markup string")


def cleaned(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): every text without its markup."""
    kind = dict(rows.dtypes)[id_col]

    trained = model()

    def run(batches) -> Iterator[pa.RecordBatch]:
        use(trained)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([clean(t) for t in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    named = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    return named.where(~maybe).unionByName(named.where(maybe).mapInArrow(run, f"id {kind}, text string"))
