"""Labelled texts for the markup model, made by rule from a seed.

Each text mixes plain sentences, sentences that only look like markup, and
constructs of one to three languages whose spans are known.  The number of
texts is a parameter of the training.
"""

from __future__ import annotations

import random

from weftgraph.llm.markup import HTML, MD, TEX, WIKI

#: Added to the family of a span that vouches for whole lines only.
LINE = 100

_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu ran tel mor sin dap kel".split()
#: Half of the texts draw on real words, so that words with capitals and endings occur.
_WORDS = "answer budget course draft edge feedback garden house index journal label meeting network office parser query report sample thread update value window year".split()

_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.far = random.Random(-seed - 1)

    def word(self) -> str:
        r = self.r
        return r.choice(_WORDS) if r.random() < 0.6 else "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        s = self.words(4, 12).capitalize()
        if self.r.random() < 0.3:
            s = s.replace(" ", self.r.choice([", ", "; ", ": ", " - ", " – "]), 1)
        return s + self.r.choice("...?!")

    def num(self) -> int:
        return self.r.choice([self.r.randint(0, 9), self.r.randint(10, 99), self.r.randint(100, 9999)])

    def decoy(self) -> str:
        """A line of plain text with characters that markup also uses."""
        r, w, n = self.r, self.word, self.num
        kind = r.randrange(22)
        forms = [
            f"{n()} * {n()} * {n()} gives {w()}, said {w()}.",
            f"We saw {w()[0]} < {w()[0]} and {w()[0]} > {w()[0]} in the {w()}.",
            f"{w()[0]}_{n()} and {w()[0]}_{n()} are the {w()} columns.",
            f"The field {w()}_{w()}_{w()} is in the {w()}.",
            f"He paid US$ {n()} & got ${n()} back.",
            f"The {w()} went from ${n()} to ${n()} per {w()}.",
            f"Load rose > {n()}% on the {w()}, i.e. < {n()}% idle.",
            f"The {w()} said '{w()}' == {w()} in its {w()}.",
            f"It was saved under {r.choice('CDE')}:\\{w()}\\{r.choice(['new', 'text', 'begin', 'section', w()])} by the {w()}.",
            f"The placeholder {{{w()}}} in the {w()} was kept.",
            f"Item #{n()} of the {w()} is done, see {w()} #{n()}.",
            f"About ~{n()} and ^ {n()} appear in the {w()}.",
            f"{w()[0].upper()}&{w()[0].upper()} asked for the {w()} again, AT&T {w()} too.",
            f'He wrote "{w()}" [sic] and {w()} [{w()}, {n()}].',
            f"The {w()} (see {w()}) costs {n()}*{n()}={n()} or {n()}^{n()}.",
            f"Use {w()}--{w()} -- not {w()} --- for {w()}.",
            f"It's the {w()}s' {w()}, '{w()}' said; rock 'n' roll.",
            f"{w()} == {w()} || {w()} != {w()} && {w()} <= {n()}.",
            f"Path /{w()}/{w()}_{n()}.txt and \\\\{w()}\\{w()}\\{w()}_v{n()}.",
            f"{w()} *{n()} and {w()} * {w()}, also {w()}* {w()}*.",
            f"{n()} $ {w()} $ {n()} and ${n()}.{n()}, {n()}$.",
            f"<{n()} {w()}, <- {w()} ->, <{n()}>, {w()}<{n()}.",
        ]
        return forms[kind]

    def phrase(self) -> str:
        """A sentence for inside a line construct, sometimes a misleading one."""
        return self.decoy() if self.r.random() < 0.3 else self.sentence()

    def code_body(self) -> str:
        r, w, n = self.r, self.word, self.num
        forms = [
            f"if ({w()} < {w()} && {w()} > {n()}) {{ {w()}(); }}",
            f"${w()} = {w()}(${w()});",
            f"# {w()} {w()}",
            f"{{{{ {w()} | {w()} }}}}",
            f"<{r.choice(['div', 'b', 'p', w()])}>{w()}</{r.choice(['div', 'b', 'p', w()])}>",
            f"for {w()} in {w()}:\n    print({w()}.{w()})",
            f"* {w()} *{w()}*, _{w()}_",
            f"\\{r.choice(['alpha', 'frac', 'textbf'])}{{{w()}}} '''{w()}'''",
            f"{w()} --{w()} {n()}",
            f"\\begin{{{w()}}}\n{w()}\n\\end{{{w()}}}",
            f"== {w()} ==",
            f"{w()} = '{w()}'",
            f"SELECT {w()} FROM {w()} WHERE {w()} = {n()}; -- [[{w()}]] &amp; [{w()}]({w()})",
        ]
        return "\n".join(r.sample(forms, r.randint(1, 3)))

    def inline_code(self) -> str:
        r, w = self.r, self.word
        return r.choice([f"{w()} <{w()}>", f"{w()} = ${w()}$", f"{w()} {{{{{w()}}}}}", f"{w()}.{w()}()", f"{w()} --{w()}", f"<{w()}>", f"*{w()}*", f"{w()}_{w()}_{w()}", f"'''{w()}'''", f"&{w()};", f"\\{w()}{{{w()}}}"])

    def path(self) -> str:
        r, w = self.r, self.word
        sep = r.choice(["/", "/", "/", "\\"])
        name = sep.join(w() for _ in range(r.randint(1, 4))) + r.choice([f"-{self.num()}.md", ".md", "", f"_{w()}_{w()}", f"#{w()}", f"?v={self.num()}", f" {w()} {self.num()}"])
        return r.choice(["", "", "../", "./", "/"]) + name

    def markdown(self) -> list[tuple[str, int | None]]:
        r, w = self.r, self.word
        s = self.sentence
        run = lambda body: [(s() + " ", None), (body, MD), (r.choice([" ", "."]) + w() + ".", None)]
        fence = r.choice(["```", "~~~"])
        forms = [
            lambda: [("#" * r.randint(1, 6) + " " + self.words(1, 4) + r.choice(["", "", " ##"]), MD)],
            lambda: [(self.words(1, 4) + "\n" + r.choice("=-") * r.randint(3, 12), MD)],
            lambda: [("\n".join(f"{'  ' * (k % 2) * r.randint(0, 1)}{mark} {self.phrase()}" for k in range(r.randint(2, 5))), MD + LINE)] if (mark := r.choice(["-", "*", "+", "- [ ]", "- [x]"])) else [],
            lambda: [("\n".join(f"{k + 1}{end} {self.phrase()}" for k in range(r.randint(2, 5))), MD + LINE)] if (end := r.choice([".", ".", ")"])) else [],
            lambda: [("\n".join("> " + self.phrase() for _ in range(r.randint(1, 3))), MD + LINE)],
            lambda: run(r.choice(["**", "*", "***"]).join(["", self.words(1, 3), ""])),
            lambda: run(r.choice(["__", "_"]).join(["", self.words(1, 3), ""])),
            lambda: run("~~" + self.words(1, 3) + "~~"),
            lambda: [(f"**{self.words(1, 3)}:** ", MD), (s(), None)],
            lambda: run(f"[{self.words(1, 2)}]({self.path()})"),
            lambda: run(f"[{self.words(1, 2)}](https://{w()}.example/{w()})"),
            lambda: run(f"[[{self.path()}]]"),
            lambda: run(f"[[{self.words(1, 3)}|{w()}]]"),
            lambda: run(f"[[https://{w()}.example/{w()}/{self.num()}.md]]"),
            lambda: [(f"![{w()}](img/{w()}-{self.num()}.png)", MD)],
            lambda: [(f"{fence}{r.choice(['', 'sql', 'text', 'python'])}\n{self.code_body()}\n{fence}", MD)],
            lambda: run("`" + self.inline_code() + "`"),
            lambda: [(f"| {w()} | {w()} | {w()} |\n|---|---|---|\n" + "\n".join(f"| {w()} | {self.num()} | {w()} |" for _ in range(r.randint(1, 4))), MD)],
            lambda: [(r.choice(["***", "---", "* * *", "___"]), MD)],
            lambda: [(s()[:-1], None), (f"[^{r.randint(1, 9)}]", MD), (".", None)],
            lambda: [(f"[^{r.randint(1, 9)}]: {self.phrase()}", MD + LINE)],
            lambda: [(f"[{w()}]: https://{w()}.example/{w()}", MD)],
            lambda: run(f"<https://{w()}.example/{w()}>"),
        ]
        return r.choice(forms)()

    def html(self) -> list[tuple[str, int | None]]:
        r, w, s = self.r, self.word, self.sentence
        h = r.randint(1, 6)
        q = r.choice("'\"")
        forms = [
            lambda: [(f"<h{h} id={q}{w()}{q}>{self.words(1, 3)}</h{h}>", HTML)],
            lambda: [(s(), None), (r.choice(["<br/>", "<br>", "<br />", "<hr>"]), HTML), (s(), None)],
            lambda: [(f"<p class={q}{w()}{q}>{s()}</p>", HTML)],
            lambda: [("<ul>\n" + "\n".join(f"<li>{s()}" + r.choice(["", "</li>"]) for _ in range(r.randint(1, 3))) + "\n</ul>", HTML)],
            lambda: [(f"<!-- {s()} -->", HTML)],
            lambda: [(f"<a href={q}/{w()}/{self.num()}.html{q} target=_blank>{self.words(1, 3)}</a>", HTML)],
            lambda: [(f"<pre><code>{w()} = {w()}\n{w()}.run()</code></pre>", HTML)],
            lambda: [(f"<table border={r.randint(0, 2)}><tr><th>{w()}<th>{w()}</tr><tr><td>{self.num()}<td>{w()}</tr></table>", HTML)],
            lambda: [(s() + " ", None), (r.choice(["&amp;", "&nbsp;", "&#8217;", "&ndash;", "&#x20AC;", "&lt;", "&gt;", "&quot;", "&eacute;"]), HTML), (" " + w(), None)],
            lambda: [(s() + f" {w()} ", None), ("&amp;", HTML), (f" {w()}: it", None), (r.choice(["&#8217;", "&rsquo;", "&#39;"]), HTML), (f"s {w()}", None), ("&nbsp;&ndash;&nbsp;", HTML), (str(self.num()), None), (r.choice(["&#x20AC;", "&euro;", "&deg;"]), HTML), (".", None)],
            lambda: [(s() + " ", None), (f"&lt;{(t := r.choice('bip'))}&gt;", HTML), (w(), None), (f"&lt;/{t}&gt;", HTML), (" was shown as text.", None)],
            lambda: [(w() + " ", None), (f"<{(t := r.choice(['b', 'i', 'em', 'strong', 'sup', 'sub', 'u', 'code', 'span', 'kbd']))}>{self.words(1, 2)}</{t}>", HTML), (" " + w(), None)],
            lambda: [(f"<style>.{w()} {{ margin: {self.num()}px }}</style>", HTML)],
            lambda: [(f"<script>var {w()} = {self.num()};</script>", HTML)],
            lambda: [(f"<div><span>{w()}: {w()} <b>{w()}</b> <i>{w()}</i></span></div>", HTML)],
            lambda: [(f"<img src={q}{w()}.png{q} alt={q}{w()}{q}/>", HTML)],
        ]
        return r.choice(forms)()

    def wiki(self) -> list[tuple[str, int | None]]:
        r, w, s = self.r, self.word, self.sentence
        eq = "=" * r.randint(2, 5)
        forms = [
            lambda: [(f"{{{{Infobox {w()}\n| {w()} = {w()}\n| {w()} = {self.num()}\n}}}}", WIKI)],
            lambda: [(s() + " ", None), (f"{{{{{self.words(1, 2)}|date={self.num()} {w()}}}}}", WIKI)],
            lambda: [(f"{{{{{w().capitalize()}|{w()}}}}}", WIKI)],
            lambda: [(f"'''{self.words(1, 2)}'''", WIKI), (" is ", None), (f"''{w()}''", WIKI), (". " + s(), None)],
            lambda: [(s() + " ", None), (r.choice(["'''", "''", "'''''"]).join(["", self.words(1, 3), ""]), WIKI), (" " + w() + ".", None)],
            lambda: [(f"{eq} {self.words(1, 4)} {eq}", WIKI)],
            lambda: [("{| class=\"wikitable\"\n! " + w() + "\n" + "".join(f"|-\n| {w()}\n" for _ in range(r.randint(1, 3))) + "|}", WIKI)],
            lambda: [(f"[[{r.choice(['File', 'Image', 'Category', 'Datei', 'Kategorie'])}:{w()}.png|thumb|{self.words(1, 3)}]]", WIKI)],
            lambda: [(f"[[Category:{w().capitalize()}]]", WIKI)],
            lambda: [(s() + " ", None), (f"[https://{w()}.example/{w()} {self.words(1, 2)}]", WIKI), (".", None)],
            lambda: [(f";{w()}: {w()}\n:{self.phrase()}", WIKI + LINE)],
        ]
        return r.choice(forms)()

    def latex(self) -> list[tuple[str, int | None]]:
        r, w, s = self.r, self.word, self.sentence
        v = lambda: r.choice("abcfgnxyz")
        forms = [
            lambda: [(f"\\{r.choice(['section', 'subsection', 'chapter'])}{{{self.words(1, 3)}}}", TEX)],
            lambda: [(s() + " Here ", None), (f"${v()}_{{{self.num()}}} = \\frac{{{v()}}}{{{v()}}}$", TEX), (" holds.", None)],
            lambda: [(s() + " ", None), (f"${v()}^{{{self.num()}}}$", TEX), (" " + w() + ".", None)],
            lambda: [(s() + " ", None), (f"${v()} {r.choice(['=', '<', '+'])} {self.num()}$", TEX), (" " + w() + ".", None)],
            lambda: [(f"$$\\int_0^1 {v()}(t)\\,dt = {self.num()}$$", TEX)],
            lambda: [(f"\\[ {v()} = {v()} + {self.num()} \\]", TEX)],
            lambda: [(s() + " ", None), (f"\\(\\{r.choice(['alpha', 'beta', 'mu'])} + {v()} = {self.num()}\\)", TEX), (".", None)],
            lambda: [(f"\\begin{{equation}}\n\\sum_{{i=1}}^{{n}} {v()}_i \\leq {self.num()}\n\\end{{equation}}", TEX)],
            lambda: [("\\begin{itemize}\n" + "\n".join(f"\\item {s()}" for _ in range(r.randint(1, 3))) + "\n\\end{itemize}", TEX)],
            lambda: [(s()[:-1], None), (f"\\{r.choice(['footnote', 'footnote', 'cite', 'label', 'emph'])}{{{r.choice([s(), w()])}}}", TEX), (r.choice([".", " " + w() + ".", ""]), None)],
            lambda: [("It is ", None), (f"\\textbf{{{w()}}}", TEX), (" and ", None), (f"\\emph{{{w()}}}", TEX), (f"~\\cite{{{w()}{self.num()}}}.", TEX)],
            lambda: [(s() + " ", None), (f"\\{r.choice(['textit', 'texttt', 'footnote', 'ref', 'label', 'underline'])}{{{w()}}}", TEX), (" " + w() + ".", None)],
        ]
        return r.choice(forms)()

    def long(self) -> list[tuple[str, int | None]]:
        """Spans of many characters or lines, and plain text that looks like them."""
        r, w, s, n = self.r, self.word, self.sentence, self.num
        v = lambda: r.choice("abcfgnxyz")
        gap = r.choice(["\n", "\n  ", "\n\n"])
        t = r.choice(["a", "b", "p", "i", "div", "span", v(), w()])
        run = lambda body, family: [(s() + " ", None), (body, family), (" " + w() + ".", None)]
        attrs = lambda sep: sep.join(f"{r.choice(['id', 'class', 'title', 'href', 'style', 'alt', 'data-' + w()])}={q}{self.words(1, 3)}{q}" for q in r.choices("'\"", k=r.randint(1, 5)))
        sums = lambda a, b: " + ".join(r.choice([f"{v()}_{{{n()}}}", f"{v()}^{{{n()}}}", f"\\frac{{{v()}}}{{{v()}_{n()}}}", f"{v()}", f"{n()}"]) for _ in range(r.randint(a, b)))
        forms = [
            lambda: run(r.choice(["**", "*", "***", "__", "_", "~~"]).join(["", self.words(30, 150), ""]), MD),
            lambda: run(r.choice(["**", "*", "***", "__", "_", "~~"]).join(["", self.words(100, 900), ""]), MD),
            lambda: run(f'<img src="data:image/png;base64,{"".join(r.choices(_BASE64, k=r.randint(200, 3000)))}" alt="{w()}"{r.choice(["", "/", " /"])}>', HTML),
            lambda: run(f"<img{gap}{attrs(gap)}{r.choice(['', gap])}{r.choice(['', '/'])}>", HTML),
            lambda: run(f"<{(u := r.choice(['a', 'b', 'p', 'div', 'span']))}{gap}{attrs(gap)}{r.choice(['', gap])}>{s()}</{u}{r.choice(['', '', gap])}>", HTML),
            lambda: run(f"<{(u := r.choice(['a', 'div', 'span']))} {attrs(' ')} {attrs(' ')}>{s()}</{u}>", HTML),
            lambda: run(f"${sums(20, 120)} = {n()}$", TEX),
            lambda: run(f"${v()}_{{{sums(8, 30)}}} = {n()}$", TEX),
            lambda: [(f"We saw {v()} <{t} and {self.words(1, 30)} in it.{gap}{self.words(2, 30)}.\n", None), (f"> {s()}", MD + LINE)],
            lambda: [(f"If {v()} <{t} then {self.words(1, 20)}{gap}{self.words(2, 20)}, so {n()} > {n()} {w()}.", None)],
            lambda: [(f"The {w()} has {w()} <{t}, {self.words(1, 20)}; {self.words(1, 20)}.{gap}{s()} {w()} -> {w()}.", None)],
            lambda: [(f"He paid ${n()} and {self.words(40, 120)} then ${n()} more.", None)],
            lambda: [(f"{n()} * {self.words(40, 120)} * {n()} and {w()}_{w()} {self.words(40, 120)} {w()}_{w()}.", None)],
        ]
        return r.choice(forms)()

    def text(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A text and its spans (start, end, family)."""
        r = self.r
        langs = r.sample([self.markdown, self.markdown, self.html, self.wiki, self.latex], r.randint(0, 3))
        blocks: list[list[tuple[str, int | None]]] = []
        for _ in range(r.randint(3, 14)):
            if langs and r.random() < 0.5:
                blocks.append(r.choice(langs)())
            elif r.random() < 0.45:
                line = [self.sentence() if r.random() < 0.4 else self.decoy() for _ in range(r.randint(1, 4))]
                twin = self.decoy()
                blocks.append([(" ".join([twin, *line, twin] if r.random() < 0.15 else line), None)])
            else:
                blocks.append([(" ".join(self.sentence() for _ in range(r.randint(1, 3))), None)])
        while self.far.random() < 0.4:
            self.r = self.far
            blocks.insert(self.r.randint(0, len(blocks)), self.long())
            self.r = r
        out, spans, at = [], [], 0
        for b in blocks:
            for piece, family in b:
                if family is not None:
                    spans.append((at, at + len(piece), family))
                out.append(piece)
                at += len(piece)
            gap = r.choice(["\n\n", "\n\n", "\n"]) if all(f is None for _, f in b) is False else "\n\n"
            out.append(gap)
            at += len(gap)
        text = "".join(out)
        if r.random() < 0.12:
            cut = r.randint(len(text) // 2, len(text))
            text, spans = text[:cut] + "…", [(a, min(b, cut), f) for a, b, f in spans if a < cut]
        return text, spans
