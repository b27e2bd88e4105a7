"""Candidate markup of a text as a tree of nodes, with features per node.

Every construct of Markdown, HTML, MediaWiki and LaTeX is looked for liberally,
so that the candidates also hold what only looks like markup.  Spans may be of
any length and tags run over line breaks; a span's classes leave out its own
delimiter, so each mark is scanned up to the next one only.  Candidates nest
by their spans; the tree gives each node its depth, siblings and subtree.
Which candidates are markup is for the model to say.
"""

from __future__ import annotations

import html.entities
import math
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

FAMILIES = ("markdown", "html", "wiki", "latex")
MD, HTML, WIKI, TEX = range(4)

#: Names that the languages define (fixed values).
TAGS = frozenset("a abbr b blockquote br button caption center cite code col dd del details div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q ref s samp script section select small source span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var video".split())
COMMANDS = frozenset("alpha begin beta bf bibitem big binom bm caption cdot cdots chapter cite citep citet cos dfrac ddots delta documentclass dots em emph end epsilon eqref eta exp footnote forall frac gamma geq ge hat hline href hspace hfill include includegraphics infty input int in item it iota kappa label lambda large ldots left leq le lim ln log max mathbb mathbf mathcal mathrm mathit min mu nabla ne neq newcommand newline newpage noindent nu omega overline page pageref paragraph partial phi pi pm prod psi quad qquad ref rho right rightarrow section sigma sin sqrt subsection subsubsection sum tau tan text textbf textit textrm texttt textsc tfrac theta times title to underline url usepackage varepsilon varphi vdots vec verb vspace wedge xi zeta".split())
ATTRIBUTES = frozenset("abbr accept action align alt autocomplete bgcolor border cellpadding cellspacing charset checked cite class color cols colspan content controls data datetime dir disabled download face for frameborder headers height hidden href hreflang id lang language media method name onclick onload placeholder rel role rows rowspan scope selected size span src srcset start style summary tabindex target title type usemap valign value width xmlns".split())
NAMESPACES = "File|Image|Media|Category|Datei|Bild|Kategorie|Fichier|Catégorie|Archivo|Categoría|Ficheiro|Categoria|Файл|Категория|Plik|Kategoria"

# name, family, opaque (what stands inside is content), characters that must occur, pattern
_M = re.M
_MS = re.M | re.S
CONSTRUCTS = [
    ("fence", MD, True, "`~", re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n`]*(?:\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)|\Z)", _MS)),
    ("code", MD, True, "`", re.compile(r"(?<!`)(`{1,2})(?!`)([^\n]*?[^`\n])\1(?!`)")),
    ("atx", MD, False, "#", re.compile(r"^ {0,3}#{1,6}[ \t]+\S[^\n]*$", _M)),
    ("setext", MD, False, "=-", re.compile(r"^(?![ \t]*(?:[-+*>|#]|\d+[.)]|=)[ \t=])[^\n]*\w[^\n]*\n {0,3}(?:={2,}|-{2,})[ \t]*$", _M)),
    ("rule", MD, False, "*-_", re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", _M)),
    ("item", MD, False, "-+*.)", re.compile(r"^[ \t]*(?:[-+*]|\d{1,4}[.)])[ \t]+\S[^\n]*$", _M)),
    ("quote", MD, False, ">", re.compile(r"^ {0,3}>[^\n]*$", _M)),
    ("table", MD, False, "|", re.compile(r"^[^\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$(?:\n[^\n]*\|[^\n]*$)*", _M)),
    ("row", MD, False, "|", re.compile(r"^[ \t]*\|(?![-}+])(?:[^|\n]+\|){2,}[ \t]*$", _M)),
    ("star", MD, False, "*", re.compile(r"(\*{1,3})(?!\*)([^*\n]+?)\1(?!\*)")),
    ("under", MD, False, "_", re.compile(r"(_{1,3})(?!_)([^_\n]+?)\1(?!_)")),
    ("strike", MD, False, "~", re.compile(r"~~(?!~)[^~\n]+?~~(?!~)")),
    ("image", MD, False, "!", re.compile(r"!\[[^\[\]\n]*\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)?")),
    ("link", MD, False, "[", re.compile(r"(?<!!)\[[^\[\]\n]*\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)?")),
    ("note", MD, False, "[", re.compile(rf"!?\[\[(?!\s*(?:{NAMESPACES})\s*:)[^\[\]\n]+(?:\]\]|…?\Z)")),
    ("footdef", MD, False, "^", re.compile(r"^\[\^[^\]\s]+\]:[^\n]*$", _M)),
    ("footref", MD, False, "^", re.compile(r"\[\^[^\]\s]+\](?!:)")),
    ("refdef", MD, False, "]", re.compile(r"^\[[^\]^\n]+\]:[ \t]*\S[^\n]*$", _M)),
    ("reflink", MD, False, "[", re.compile(r"(?<![\[!])\[[^\[\]\n]+\]\[[^\[\]\n]*\]")),
    ("autolink", MD, False, "<", re.compile(r"<(?:https?://|mailto:)[^<>\s]+>")),
    ("comment", HTML, True, "<", re.compile(r"<!--.*?(?:-->|\Z)", re.S)),
    ("tag", HTML, False, "<", re.compile(r"</?[A-Za-z](?!ttps?:|ailto:)[^<>]*>")),
    ("entity", HTML, False, "&", re.compile(r"&#?[A-Za-z0-9]{1,31};?")),
    ("template", WIKI, False, "{", re.compile(r"\{\{(?:[^{}]|\{(?!\{)[^{}]*\}|\{\{[^{}]*\}\})*(?:\}\}|…?\Z)")),
    ("wtable", WIKI, False, "{", re.compile(r"^ {0,3}\{\|.*?(?:^\|\}|\Z)", _MS)),
    ("whead", WIKI, False, "=", re.compile(r"(?<![=\w])(={2,6})(?![=\s]*$)[^=\n]+(?:={2,6})?", _M)),
    ("wquote", WIKI, False, "'", re.compile(r"('{2,5})(?!')([^'\n](?:[^\n]*?[^'\n])?)\1(?!')")),
    ("wfile", WIKI, False, "[", re.compile(rf"\[\[:?\s*(?:{NAMESPACES})\s*:(?:[^\[\]\n]|\[\[[^\]\n]*\]\])*(?:\]\]|…?\Z)", re.I)),
    ("wext", WIKI, False, "[", re.compile(r"(?<!\[)\[(?:https?:)?//\S+[^\]\n]*\](?!\()")),
    ("wdef", WIKI, False, ";:", re.compile(r"^[;:]+[ \t]*\S[^\n]*$", _M)),
    ("magic", WIKI, False, "_~", re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|(?<!~)~{4,5}(?!~)(?=\s|$)")),
    ("env", TEX, False, "\\", re.compile(r"\\begin\{([A-Za-z]+\*?)\}.*?(?:\\end\{\1\}|\Z)", re.S)),
    ("display", TEX, False, "$\\", re.compile(r"\$\$(?!\$)[^$]+?\$\$|\\\[.+?\\\]", re.S)),
    ("inline", TEX, False, "$", re.compile(r"(?<![\$\\])\$(?!\$)([^$\n]+?)\$(?!\$)")),
    ("paren", TEX, False, "\\", re.compile(r"\\\([^\n]+?\\\)")),
    ("command", TEX, False, "\\", re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\})*")),
    ("sub", TEX, False, "_^", re.compile(r"(?<![\w\\])[A-Za-z][_^](?:\{[^{}\n]+\}|\w)")),
]
NAMES = [c[0] for c in CONSTRUCTS] + ["element"]
FAMILY = [c[1] for c in CONSTRUCTS] + [HTML]
OPAQUE = [c[2] for c in CONSTRUCTS] + [False]
ELEMENT = len(CONSTRUCTS)
_ID = {n: i for i, n in enumerate(NAMES)}
TAG, QUOTE = _ID["tag"], _ID["quote"]
_BLOCK_FIRST = {_ID[n] for n in ("fence", "comment", "wtable", "env", "display", "template", "table")}
FEATURES = ("construct", "family", "log_length", "newlines", "before", "after", "inner_first_blank", "inner_last_blank", "letters", "digits", "words", "known", "attributes", "known_attributes", "quoted_attributes", "equals", "closed", "line_start", "line_end", "depth", "parent", "siblings", "same_siblings", "subtree", "density", "position", "formula_signs")


class Node:
    __slots__ = ("kind", "start", "end", "parent", "children", "depth", "match", "score", "on")

    def __init__(self, kind: int, start: int, end: int, match=None):
        self.kind, self.start, self.end, self.match = kind, start, end, match
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.depth = 0
        self.score = 0.0
        self.on = False


def candidates(text: str) -> list[Node]:
    """All candidate nodes, not yet nested."""
    found: list[Node] = []
    for kind, (_, _, _, chars, pattern) in enumerate(CONSTRUCTS):
        for ch in chars:
            if ch in text:
                break
        else:
            continue
        for m in pattern.finditer(text):
            found.append(Node(kind, m.start(), m.end(), m))
    return found


_OPEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)")
_VOID = frozenset("br hr img input meta link col source".split())


def _elements(nodes: list[Node]) -> list[Node]:
    """Element nodes over pairs of an opening and its closing tag."""
    tag = _ID["tag"]
    stack: list[tuple[str, Node]] = []
    out: list[Node] = []
    for n in sorted((n for n in nodes if n.kind == tag), key=lambda n: n.start):
        m = _OPEN.match(n.match.group())
        if not m:
            continue
        name = m.group(2).lower()
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    out.append(Node(ELEMENT, stack[k][1].start, n.end, stack[k][1].match))
                    del stack[k:]
                    break
        elif name not in _VOID and not n.match.group().endswith("/>"):
            stack.append((name, n))
    return out


def tree(text: str) -> list[Node]:
    """The nodes in document order, nested; of crossing spans the earlier is kept
    whole and the later becomes its sibling's follower where it starts."""
    nodes = candidates(text)
    nodes += _elements(nodes)
    nodes.sort(key=lambda n: (n.start, -n.end, n.kind not in _BLOCK_FIRST, n.kind))
    stack: list[Node] = []
    for n in nodes:
        while stack and (stack[-1].end <= n.start or stack[-1].end < n.end):
            stack.pop()
        if stack:
            n.parent = stack[-1]
            n.depth = n.parent.depth + 1
            n.parent.children.append(n)
        stack.append(n)
    return nodes


def _char_class(text: str, i: int) -> int:
    if i < 0 or i >= len(text) or text[i] == "\n":
        return 0
    ch = text[i]
    return 1 if ch.isspace() else 3 if ch.isalnum() else 4 if ch == "\\" else 2


_ENTITIES = frozenset(k for k in html.entities.html5 if k.endswith(";"))
_NAME = re.compile(r"[A-Za-z]+")
_INNER = {_ID["star"]: 2, _ID["under"]: 2, _ID["inline"]: 1, _ID["wquote"]: 2, _ID["code"]: 2}
_CLASSES = (str.isalpha, str.isdigit, frozenset("\\^_{}=+").__contains__)


def _known(n: Node, raw: str) -> int:
    name = NAMES[n.kind]
    if name in ("tag", "element"):
        m = _OPEN.match(raw)
        return int(bool(m) and m.group(2).lower() in TAGS)
    if name == "entity":
        return int(raw.endswith(";") and (raw[1] == "#" and raw[2:-1] != "" or raw[1:] in _ENTITIES))
    if name == "command":
        return int(_NAME.search(raw).group() in COMMANDS)
    return 0


_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")


def _attributes(n: Node) -> tuple[int, int, int]:
    """Attributes of a tag, or of an element's opening tag: how many there are,
    how many have a name that HTML defines, and how many a quoted value."""
    if n.kind != TAG and n.kind != ELEMENT:
        return 0, 0, 0
    tag = n.match.group()
    m = _OPEN.match(tag)
    found = _ATTRIBUTE.findall(tag, m.end(), len(tag) - 1) if m else []
    known = sum(k.lower() in ATTRIBUTES or k.lower().startswith(("data-", "aria-")) for k, _ in found)
    return len(found), known, sum(v[:1] in ('"', "'") for _, v in found if v)


def features(text: str, nodes: list[Node]) -> list[list[float]]:
    """One row of FEATURES per node."""
    size: dict[int, int] = {}
    for n in reversed(nodes):
        size[id(n)] = 1 + sum(size[id(c)] for c in n.children)
    place: dict[int, int] = {}
    same: dict[tuple[int, int], int] = {}
    roots = 0
    for n in nodes:
        key = id(n.parent) if n.parent else 0
        if n.parent:
            pass
        place[id(n)] = same.get((key, -1), 0)
        same[(key, -1)] = place[id(n)] + 1
        same[(key, n.kind)] = same.get((key, n.kind), 0) + 1
        roots += n.parent is None
    sums: list[array] = []  # characters of each class before each place, made when a long node needs them
    rows = []
    for n in nodes:
        raw = n.match.group() if n.kind != ELEMENT else text[n.start : n.end]
        g = _INNER.get(n.kind)
        a, b = n.match.span(g) if g else (n.start, n.end)
        inner = text[a:b] if g else raw
        if b - a > 400:
            sums = sums or [array("i", accumulate(map(f, text), initial=0)) for f in _CLASSES]
            letters, digits, signs = [(s[b] - s[a]) / (b - a) for s in sums]
        else:
            letters, digits, signs = [sum(map(f, inner)) / (b - a) for f in _CLASSES]
        span = n.end - n.start
        key = id(n.parent) if n.parent else 0
        name = NAMES[n.kind]
        if name == "whead":
            closed = raw.rstrip().endswith(n.match.group(1)) and raw.strip() != n.match.group(1)
        elif name == "env":
            closed = raw.endswith("}") and "\\end{" in raw
        elif name in ("fence", "comment", "template", "wtable", "link", "image", "note", "wfile"):
            closed = n.end < len(text) or raw[-1] in ")]}`~>"
        else:
            closed = True
        rows.append(
            [
                n.kind, FAMILY[n.kind], math.log1p(span), raw.count("\n"), _char_class(text, n.start - 1), _char_class(text, n.end),
                inner[:1].isspace(), inner[-1:].isspace(), letters, digits, inner.count(" ") + 1, _known(n, raw),
                *_attributes(n), raw.count("="), closed, n.start == 0 or text[n.start - 1] == "\n", n.end == len(text) or text[n.end] == "\n",
                n.depth, n.parent.kind if n.parent else -1, same[(key, -1)], same[(key, n.kind)], size[id(n)],
                sum(c.end - c.start for c in n.children) / span, place[id(n)], signs,
            ]
        )
    return rows


#: What may be markup inside an accepted node of a family; code and comments hold none.
_INSIDE = {TEX: (TEX,)}
#: Constructs of whole lines; what stands in them is judged on its own.
LINES = frozenset(_ID[n] for n in ("atx", "setext", "rule", "item", "quote", "table", "row", "footdef", "refdef", "wdef", "whead"))
_BLOCK_MATH = frozenset(_ID[n] for n in ("display", "inline", "paren"))


def decode(nodes: list[Node], logits: list[float]) -> None:
    """Choose the nodes that are markup: the best consistent choice of the tree.

    An accepted code block, code span or comment makes all below it content;
    an accepted formula leaves only LaTeX below it.  For every node the gain of
    accepting it (its log-odds and the best of its subtree under that
    restriction) is held against leaving it out.  What starts inside an accepted
    tag and runs past it (a line that begins with its ``>``) is part of the tag.
    """
    free: dict[int, float] = {}
    tex: dict[int, float] = {}
    for n, s in zip(reversed(nodes), reversed(logits)):
        n.score = s
        below_free = sum(free[id(c)] for c in n.children)
        below_tex = sum(tex[id(c)] for c in n.children)
        if OPAQUE[n.kind]:
            # code that is code decides about all below it
            free[id(n)] = s if s > 0 else below_free
            tex[id(n)] = below_tex
        else:
            inside = below_tex if n.kind in _BLOCK_MATH else below_free
            free[id(n)] = max(s + inside, below_free)
            tex[id(n)] = max(0.0, s) + below_tex if FAMILY[n.kind] == TEX else below_tex
    mode: dict[int, int] = {}  # 0 free, 1 only LaTeX, 2 content
    for n in nodes:
        m = mode[id(n.parent)] if n.parent else 0
        n.on, mode[id(n)] = False, m
        if m == 1:
            n.on = FAMILY[n.kind] == TEX and n.score > 0
        elif m == 0 and OPAQUE[n.kind]:
            n.on = n.score > 0
            mode[id(n)] = 2 if n.on else 0
        elif m == 0:
            below_free = sum(free[id(c)] for c in n.children)
            inside = sum(tex[id(c)] for c in n.children) if n.kind in _BLOCK_MATH else below_free
            n.on = n.score + inside > below_free
            mode[id(n)] = 1 if n.on and n.kind in _BLOCK_MATH else 0
    end = 0
    for n in nodes:
        if n.on and n.start < end < n.end:
            n.on = False
        elif n.on and n.kind == TAG:
            end = n.end


def kinds(nodes: list[Node]) -> set[int]:
    """Families of the accepted nodes."""
    return {FAMILY[n.kind] for n in nodes if n.on}


# ---- clean text -------------------------------------------------------------

_LISTS = re.compile(r"^([ \t]*)(?:[*+-]|(\d+)[.)])[ \t]+(?:\[[ xX]\][ \t]+)?")


def render(text: str, nodes: list[Node]) -> str:
    """Clean text: headings as ``#`` lines, list items as ``-`` or numbered lines,
    code blocks between fences, formulas between ``$``; all other marks removed."""
    out = _render(text, 0, len(text), [n for n in nodes if n.parent is None])
    out = re.sub(r"[ \t]+$", "", out, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def _shown(nodes: list[Node]) -> Iterator[Node]:
    """The accepted nodes next below; what is left out hides nothing that crosses it."""
    todo = nodes[::-1]
    while todo:
        n = todo.pop()
        if n.on:
            yield n
        else:
            todo += n.children[::-1]


def _render(text: str, a: int, b: int, nodes: list[Node]) -> str:
    pieces, at = [], a
    for n in _shown(nodes):
        if n.start < at or n.end > b:
            continue
        pieces.append(text[at : n.start])
        pieces.append(_one(text, n))
        at = n.end
    pieces.append(text[at:b])
    return "".join(pieces)


def _inner(text: str, n: Node, a: int, b: int) -> str:
    return _render(text, a, b, n.children)


def _one(text: str, n: Node) -> str:
    name, raw = NAMES[n.kind], text[n.start : n.end]
    if name == "fence":
        lines = raw.split("\n")
        body = lines[1:-1] if len(lines) > 1 and re.match(r"\s*[`~]{3}", lines[-1]) else lines[1:]
        return "```\n" + "\n".join(body) + "\n```"
    if name == "code":
        return n.match.group(2).strip()
    if name == "atx":
        level = len(raw.lstrip()) - len(raw.lstrip().lstrip("#"))
        shift = n.start + len(raw) - len(raw.lstrip(" #\t"))
        return "#" * level + " " + re.sub(r"\s+#+\s*$", "", _inner(text, n, shift, n.end))
    if name == "setext":
        cut = n.start + raw.index("\n")
        return ("# " if "=" in raw[raw.index("\n") :] else "## ") + _inner(text, n, n.start, cut)
    if name in ("rule", "comment", "magic", "footref", "refdef"):
        return ""
    if name == "item":
        m = _LISTS.match(raw)
        return m.group(1) + (f"{m.group(2)}. " if m.group(2) else "- ") + _inner(text, n, n.start + m.end(), n.end)
    if name == "quote":
        return _inner(text, n, n.start + len(raw) - len(raw.lstrip(" >\t")), n.end)
    if name in ("table", "row"):
        rows = [r.strip().strip("|") for r in raw.split("\n") if not re.fullmatch(r"[ \t|:-]+", r)]
        return "\n".join(" | ".join(c.strip() for c in r.split("|")) for r in rows)
    if name in ("star", "under", "wquote"):
        k = len(n.match.group(1))
        return _inner(text, n, n.start + k, n.end - k)
    if name == "strike":
        return _inner(text, n, n.start + 2, n.end - 2)
    if name in ("image", "link", "reflink"):
        return re.match(r"!?\[([^\]]*)\]", raw).group(1)
    if name in ("note", "wfile"):
        inner = raw.strip("![]…")
        if name == "wfile":
            return inner.rsplit("|", 1)[1] if "|" in inner else ""
        return inner.rsplit("|", 1)[1] if "|" in inner else inner
    if name == "footdef":
        return _inner(text, n, n.start + raw.index(":") + 1, n.end).strip()
    if name == "autolink":
        return raw[1:-1]
    if name == "wext":
        return raw[1:-1].partition(" ")[2] or raw[1:-1]
    if name == "entity":
        return html.unescape(raw)
    if name == "tag":
        m = _OPEN.match(raw)
        return "\n" if m and m.group(2).lower() in ("br", "p", "div", "tr", "li", "hr") and not m.group(1) else ""
    if name == "element":
        return _element(text, n)
    if name == "template":
        inner = raw.strip("{}…")
        cells = [c.strip() for c in inner.split("|")[1:]]
        return "\n".join(f"{k.strip()}: {v.strip()}" for k, _, v in (c.partition("=") for c in cells) if v) if "\n" in inner else ""
    if name == "wtable":
        rows = [re.sub(r"^[!|]\s*", "", r).strip() for r in raw.split("\n")[1:] if not re.match(r"\|[-}+]", r)]
        return "\n".join(re.sub(r"\s*(?:\|\||!!)\s*", " | ", r) for r in rows)
    if name == "whead":
        level = len(n.match.group(1))
        return "#" * level + " " + raw.strip().strip("=").strip()
    if name == "wdef":
        return _inner(text, n, n.start + len(raw) - len(raw.lstrip(";: \t")), n.end)
    if name in ("display", "inline", "paren"):
        body = raw.strip("$")
        body = body[2:-2] if raw[0] == "\\" else body
        return f"$${body.strip()}$$" if name == "display" else f"${body.strip()}$"
    if name == "env":
        kind = n.match.group(1)
        a, b = n.start + raw.index("}") + 1, n.end - (len(kind) + 6 if raw.endswith("}") else 0)
        if kind.rstrip("*") in ("equation", "align", "gather", "math", "displaymath", "eqnarray", "multline"):
            return "$$" + text[a:b].strip() + "$$"
        if kind in ("verbatim", "lstlisting"):
            return "```\n" + text[a:b].strip("\n") + "\n```"
        return _inner(text, n, a, b).strip("\n")
    if name == "command":
        return _command(text, n, raw)
    return raw


def _element(text: str, n: Node) -> str:
    name = _OPEN.match(n.match.group()).group(2).lower()
    a, b = n.match.end(), text.rindex("<", n.start, n.end)
    if name in ("script", "style"):
        return ""
    if name == "pre":
        return "```\n" + html.unescape(re.sub(r"<[^>]*>", "", text[a:b])).strip("\n") + "\n```"
    inner = _inner(text, n, a, b)
    if re.fullmatch("h[1-6]", name):
        return "\n" + "#" * int(name[1]) + " " + inner.strip() + "\n"
    if name == "li":
        return "\n- " + inner.strip()
    if name in ("td", "th"):
        return inner.strip() + " | "
    if name in ("p", "div", "tr", "ul", "ol", "table", "blockquote"):
        return "\n" + inner.strip("\n").removesuffix(" | ") + "\n"
    return inner


def _command(text: str, n: Node, raw: str) -> str:
    name = _NAME.search(raw).group()
    arg = re.search(r"\{(.*)\}$", raw, re.S)
    inner = _inner(text, n, n.start + arg.start() + 1, n.end - 1) if arg else ""
    if name in ("section", "subsection", "subsubsection", "chapter", "title"):
        return "#" * (1 + name.count("sub") + (name != "chapter")) + " " + inner
    if name == "item":
        return "-"
    if name in ("cite", "citep", "citet", "label", "ref", "pageref", "eqref", "begin", "end", "noindent", "newline", "newpage", "vspace", "hspace", "usepackage", "documentclass"):
        return ""
    return inner if arg else ("" if name in COMMANDS and n.parent is None and not raw.startswith(("\\sum", "\\int")) else raw)
