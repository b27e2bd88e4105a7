"""Text that was decoded with a wrong character encoding: find and restore.

The characters of a text are mapped back to the bytes of a legacy code page.
A byte-structure automaton (the well-formed UTF-8 sequences, as one regular
expression over the mapped bytes) finds the maximal multibyte spans, and only
those spans are decoded; the rest of the text is left as it stands.  The pass
repeats until nothing changes, which undoes double encoding.  Which page a text
was read in, a model of neighbouring characters decides; it is fitted on all
texts of the corpus itself but those that hold such spans.  Where the automaton
rejects the bytes (single-byte text read in another single-byte page), the same
model scores every pair of pages, for any language.  U+FFFD marks what cannot be
restored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weftgraph.llm.letters import PROOF, SIZE, WORD, LetterModel, count_pairs
from weftgraph.session import Scratch

#: Nats by which a word must gain when its multibyte spans are decoded.
SPAN_GAIN = 2.0
PAGES = ("cp1252", "iso8859_15", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp866", "koi8_r", "iso8859_2")

_WELL_FORMED = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
#: Two-byte sequences count only where they give one of these: Latin-1 signs and
#: letters, Latin letters of the European languages, Russian letters, accents,
#: and what a Western page shows for C1 bytes (a step of double encoding).
_PLAUSIBLE = re.compile("[\xa0-\xffĀ-žȘ-țƒˆ˜А-яЁё\u0301ҐґЄєІіЇї\u0600-\u06ff]")
#: Decoded letters that are rarer than the accident that forms them.
_UNLIKELY = re.compile("[ĀāĂăĈ-ċĒ-ĕĖėĜ-ġĤ-ħĨ-ĭĴ-ķĸĻ-ĿŀŅ-ŋŌ-ŏŔŕŖŗŜ-şŢ-ŧŨ-ŭŰ-ųŴ-ŷ]")
#: Characters that ordinary text does not hold next to letters.
_ODD = re.compile("[\x80-\x9fÂÃÐÑƒ€‚„†‡ˆ‰Š‹ŒŽ˜™š›žŸЂЃѓЉЊЌЋЏђљњќћџЎўЈҐґЅѕІіЇїЄєј─-▟√≈∂∑∏π∫ΩΓ⌐¬◊∆∞≠≤≥ĂĹĽŤťŹ]")
_CYR = re.compile("[А-яЁё]")
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿĀ-ž]")
_RUN = re.compile("[^\x00-\x7f]{2,}")


class _Page(dict):
    """str.translate table: characters to chr(byte), all others to U+0100."""

    def __init__(self, name: str):
        super().__init__((i, i) for i in range(0xA0))
        for b in range(0x80, 0x100):
            try:
                self[ord(bytes([b]).decode(name))] = b
            except UnicodeDecodeError:
                pass
        self.cache: dict[str, list] = {}
        self.words: dict[str, str | None] = {}

    def __missing__(self, key: int) -> int:
        return 0x100

    def spans(self, run: str) -> list[tuple[int, int, str]]:
        """Maximal well-formed multibyte spans of a run, with what they decode to."""
        found = self.cache.get(run)
        if found is None:
            mapped = run.translate(self)
            found = [(*m.span(), m.group().encode("latin-1").decode("utf-8")) for m in _WELL_FORMED.finditer(mapped)]
            if len(self.cache) > 50_000:
                self.cache.clear()
            self.cache[run] = found
        return found


_TABLES: dict[str, _Page] = {}


def _page(name: str) -> _Page:
    if name not in _TABLES:
        _TABLES[name] = _Page(name)
    return _TABLES[name]


def _readable(out: str, any_letter: bool = False) -> bool:
    """Whether a decoded span can be text; with ``any_letter`` letters are left to the model."""
    for ch in out:
        if "\x80" <= ch <= "\x9f":
            if len(out) < 2 and not any_letter:
                return False
        elif ch < "\u0800":
            if any_letter:
                continue
            if not _PLAUSIBLE.match(ch) or _UNLIKELY.match(ch):
                return False
        elif "\ue000" <= ch <= "\uf8ff" or not (ch.isprintable() or ch.isspace() or "\u200b" <= ch <= "\u200f"):
            return False
    return True


def _accept(before: str, after: str, raw: str, out: str, page: str, cyrillic: bool) -> bool:
    """Whether a well-formed span is garbled text rather than an accident.

    ``cyrillic``: the text holds Cyrillic letters outside such spans.
    """
    if not _readable(out):
        return False
    if page in ("cp866", "koi8_r", "iso8859_2"):
        return len(out) >= 2 and bool(_ODD.search(raw))
    if page == "cp1251":
        return bool(_ODD.search(raw)) or len(out) >= 3 or not cyrillic or bool(_LATIN.search(before + after))
    if page == "mac_roman":
        return bool(re.search("[√ƒ≈¬∆∂∑∏π∫Ω≠∞≤≥]|‚[ÄÇ]", raw)) or len(out) >= 3
    return bool(_ODD.search(raw)) or len(out) >= 2 or out in "\xa0" or not out.isspace()


def _spans_of(text: str, page: str) -> list[tuple[int, int, str]]:
    table = _page(page)
    return [(m.start() + a, m.start() + b, out) for m in _RUN.finditer(text) for a, b, out in table.spans(m.group())]


def _decoded(word: str, page: str) -> str | None:
    """The word with its readable spans decoded; None if it has none.  Kept per page."""
    known = _page(page).words
    new = known.get(word, "")
    if new == "":
        if len(known) > 100_000:
            known.clear()
        spans = [x for x in _spans_of(word, page) if _readable(x[2], True)]
        new = known[word] = _put(word, spans) if spans else None
    return new


def _put(text: str, spans: list[tuple[int, int, str]]) -> str:
    pieces, last = [], 0
    for a, b, out in spans:
        pieces += [text[last:a], out]
        last = b
    return "".join(pieces) + text[last:]


def _proves(word: str, new: str, page: str) -> bool:
    """Whether a word may prove the page: in Cyrillic text a capital before a
    quote mark (cp1251) is well-formed by accident."""
    return page != "cp1251" or len(word) - len(new) > 1 or bool(re.search("[A-Za-z]", word) or _ODD.search(word))


def _likely_spans(text: str, model: LetterModel) -> str:
    """The multibyte spans of one page decoded in the words that gain by it; of
    the page under which the words with rare pairs gain most."""
    words = [w for w in dict.fromkeys(WORD.findall(text)) if _RUN.search(w)]
    odd = set(model.odd(words))
    if not odd:
        return text
    best, gain = {}, 0.0
    tried: list[dict[str, str]] = []
    for name in PAGES:
        new = {w: x for w in words if (x := _decoded(w, name)) is not None}
        if not new or new in tried:
            continue
        tried.append(new)
        gains = dict(zip(new, model.gains(list(new), list(new.values()))))
        total = sum(g for w, g in gains.items() if g > SPAN_GAIN and w in odd and _proves(w, new[w], name))
        if total > gain:
            best, gain = {w: x for w, x in new.items() if gains[w] > SPAN_GAIN}, total
    return WORD.sub(lambda m: best.get(m.group(), m.group()), text) if best else text


def _plain_spans(text: str) -> str:
    """The spans of the page with most in them, as far as rules tell them from accidents."""
    best, gain = text, 0
    for name in PAGES:
        spans = _spans_of(text, name)
        if sum(b - a for a, b, _ in spans) <= gain:
            continue
        cyrillic = False
        if name == "cp1251":
            own = sum(len(_CYR.findall(text[a:b])) for a, b, _ in spans)
            odd = sum(1 for a, b, _ in spans if _ODD.search(text[a:b]))
            cyrillic = len(_CYR.findall(text)) > own and odd < 5
        spans = [(a, b, out) for a, b, out in spans if _accept(text[a - 1 : a], text[b : b + 1], text[a:b], out, name, cyrillic)]
        found = sum(b - a for a, b, _ in spans)
        if found > gain:
            best, gain = _put(text, spans), found
    return best


def _c1(m: re.Match) -> str:
    """A C1 control is a byte of cp1252 that was read as Latin-1."""
    try:
        return m.group().encode("latin-1").decode("cp1252")
    except UnicodeError:
        return m.group()


_LOST = re.compile("[\x80-\x9f\ufffd]")


def _suspect_run(run: str) -> bool:
    return any(_accept("", "", run[a:b], out, p, False) for p in PAGES for a, b, out in _page(p).spans(run))


def suspect(text: str, model: LetterModel | None = None) -> bool:
    """Whether a text may be garbled; a text that is not suspect never is.

    Garbled text shows in C1 controls and U+FFFD, or in words with pairs of
    characters that the model hardly knows; words met before are only looked up.
    """
    if text.isascii():
        return False
    if _LOST.search(text):
        return True
    if model is not None and not model.weak:
        return model.any_odd({t for t in text.replace("\n", " ").split(" ") if not t.isascii()})
    return any(_suspect_run(run) for run in set(_RUN.findall(text)))


def repair(text: str | None, model: LetterModel | None = None) -> str | None:
    """The text with garbled spans restored; null stays null, clean text as it is.

    In each round the multibyte spans of one page and the words of one pair of
    single-byte pages compete by what the model gains.  Without a model, or with
    one of very few texts, rules tell the spans and nothing else is decoded.
    """
    if not text or text.isascii():
        return text
    seen = {text}
    while True:
        new = _plain_spans(text) if model is None or model.weak else _likely_spans(text, model)
        if model is not None and not model.weak:
            turned = model.turn(text)
            if turned != text and (new == text or model.gain(text, turned) > model.gain(text, new)):
                new = turned
        if new in seen:  # nothing changed; rounds that undo each other end here too
            break
        seen.add(new)
        text = new
    return re.sub("[\x80-\x9f]", _c1, text)


def _is_clean(text: str) -> bool:
    return not (_LOST.search(text) or any(_suspect_run(run) for run in set(_RUN.findall(text))))


def fit_letters(texts: list[str]) -> LetterModel:
    """A model of the clean ones among ``texts``; those it would change are left out of the second fit."""
    words = [WORD.findall(t) for t in texts if not t.isascii() and _is_clean(t)]
    model = LetterModel(count_pairs(w for ws in words for w in ws))
    good = [ws for ws in words if model.turn(" ".join(ws)) == " ".join(ws)]
    return LetterModel(count_pairs(w for ws in good for w in ws))


def letter_model(df: DataFrame, text: str, texts: int | None = None) -> LetterModel:
    """The model of all distinct clean texts; with ``texts`` of about so many of them, taken by their hash.

    Texts are read once and only their words beyond ASCII, all that the model
    counts, are kept; of the executors' work only the counts of pairs come back.
    """
    rows = df.select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).where("t <> ''")
    if texts is not None:
        share = min(1.0, texts / max(1, rows.count()))
        rows = rows.where(F.pmod("h", F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, kept = [], []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t.isascii() and _is_clean(words := " ".join(WORD.findall(t))):
                    hashes.append(h)
                    kept.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(kept, pa.string())], names=["h", "words"])

    scratch = Scratch(df.sparkSession, "letters")
    distinct = scratch.cut(rows.mapInArrow(clean, "h bigint, words string").distinct().select("words"), "words")

    def counts(model: LetterModel | None) -> LetterModel:
        def stays(words: str) -> bool:
            odd = model.odd(list(set(words.split(" "))))
            return not any(len(w) >= PROOF for w in odd) or model.turn(words) == words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(SIZE * SIZE, np.int64)
            for batch in batches:
                for at in range(0, len(batch), 500):
                    # the spaces between words are borders like those of count_pairs itself
                    found = count_pairs(w for w in batch.column(0).slice(at, 500).to_pylist() if model is None or stays(w))
                    seen[found[:, 0]] += found[:, 1]
            pairs = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(seen[pairs])], names=["pair", "n"])

        got = distinct.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # bounded by the pairs there are
        return LetterModel(np.array([(r[0], r[1]) for r in got], np.int64).reshape(-1, 2))

    model = counts(counts(None))
    scratch.close()
    return model


def restore(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per garbled text: ``key``, ``restored`` and ``lost``.

    ``lost`` counts the characters that cannot be restored (U+FFFD).  Null,
    empty and clean texts give no row; a repeated row is given as often as it
    occurs; a null key is kept.  Texts of any length are read whole.
    """
    model = letter_model(df, text)
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, outs, lost = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not suspect(t, model):
                    continue
                new = repair(t, model)
                gone = t.count("\ufffd")
                if gone or new != t:
                    keys.append(k)
                    outs.append(new)
                    lost.append(gone)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(outs, pa.string()), pa.array(lost, pa.int64())], names=["k", "restored", "lost"])

    schema = StructType([StructField("k", LongType()), StructField("restored", StringType()), StructField("lost", LongType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)
