"""A model of neighbouring characters, and code pages scored by it.

The model holds how often two characters stand side by side in words of the
clean part of a corpus.  A word that was decoded with a wrong single-byte page
has pairs that the corpus does not know; mapped back to bytes and decoded with
the right page, it has common ones.  Every pair of pages is scored for all
words in question at once, by array look-ups.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

#: Single-byte pages between which text may have been confused.
SINGLE = ("cp1252", "latin-1", "iso8859_15", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "mac_roman", "cp437", "cp850", "cp852")
#: Words with characters beyond ASCII; only they can be garbled.
WORD = re.compile("(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7f](?:[A-Za-z]|[^\x00-\x7f])*")
#: A model of fewer pairs than this tells nothing.
LEAST_PAIRS = 5_000
#: A pair of characters seen less often than this makes a word worth a look; among more
#: pairs than RARE_IN as many times more, since the garbled texts grow with the corpus.
RARE, RARE_IN = 3, 2_000_000
#: Nats by which a word must gain in another page to count as turned, and all turned words of a text together.
WORD_GAIN, TEXT_GAIN = 4.0, 9.0
#: Log-likelihood of an unseen pair with a character that no page has.
FOREIGN = -30.0
#: Characters of a word that can prove a text garbled; shorter ones (m³) turn with others.
PROOF = 4
#: Pairs of pages whose gains over the rare words come first are compared over all words.
CLOSE = 8
#: A word that loses less than UNSURE turns if those around it do, or if more than this share of all do.
WHOLE_SHARE, UNSURE = 0.8, 8.0


def _high(page: str) -> dict[int, str]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(page)
        except UnicodeDecodeError:
            pass
    return out


_HIGH = {p: _high(p) for p in SINGLE}
#: Characters that the model tells apart: ASCII letters and all that a page shows; 0 is any border, 1 any other.
_CHARS = sorted({c for h in _HIGH.values() for c in h.values()})
_CODE = np.ones(0x110000, np.int32)
_CODE[:0x80] = 0
for _k, _c in enumerate([chr(x) for x in range(0x80) if chr(x).isalpha()] + _CHARS):
    _CODE[ord(_c)] = _k + 2
SIZE = 2 + 52 + len(_CHARS)


_SCRIPT = np.zeros(SIZE, np.int8)
_SCRIPT[2:54] = 1
for _c in _CHARS:
    _SCRIPT[_CODE[ord(_c)]] = 2 if "\u0400" <= _c <= "\u04ff" else 1 if _c.isalpha() and _c < "\u0250" and _c not in "ªº" else 0
#: Latin beside Cyrillic.
_MIXED = (_SCRIPT[:, None] * _SCRIPT[None, :]) == 2


def _turning(seen: str, meant: str) -> np.ndarray:
    """Codes of characters in one page to codes of what their bytes mean in the other; -1: none."""
    out = np.full(SIZE, -1, np.int32)
    out[0] = 0
    out[2:54] = np.arange(2, 54)
    for b, c in _HIGH[seen].items():
        if b in _HIGH[meant]:
            out[_CODE[ord(c)]] = _CODE[ord(_HIGH[meant][b])]
    return out


PAIRS = [(s, m) for s in SINGLE for m in SINGLE if s != m and _HIGH[s] != _HIGH[m]]
_TURNS = np.stack([_turning(s, m) for s, m in PAIRS])
_TABLES = {(s, m): {ord(c): _HIGH[m][b] for b, c in _HIGH[s].items() if b in _HIGH[m]} for s, m in PAIRS}


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all words, each behind a border and the last before one; where they start."""
    text = "\n" + "\n".join(words) + "\n"
    at = _CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.cumsum([0, *[len(w) + 1 for w in words[:-1]]])
    return at, starts


def count_pairs(words: Iterable[str]) -> np.ndarray:
    """Distinct pair codes of the words and their counts, as two columns."""
    words = list(words)
    if not words:
        return np.zeros((0, 2), np.int64)
    at, _ = codes(words)
    pair, n = np.unique(at[:-1].astype(np.int64) * SIZE + at[1:], return_counts=True)
    return np.stack([pair, n], 1)


class LetterModel:
    """Joint frequencies of character pairs; ``counts`` as from ``count_pairs``."""

    def __init__(self, counts: np.ndarray):
        seen = np.zeros(SIZE * SIZE)
        np.add.at(seen, counts[:, 0], counts[:, 1])
        self.weak = seen.sum() < LEAST_PAIRS
        self.log = np.log((seen + 0.3) / (seen.sum() + 0.3 * SIZE)).astype(np.float32).reshape(SIZE, SIZE)
        # next to characters of no page (class 1) an unseen pair is far less likely than by chance alone
        other = np.zeros((SIZE, SIZE), bool)
        other[1], other[:, 1] = True, True
        self.log[other & (seen.reshape(SIZE, SIZE) == 0)] = FOREIGN
        self.rare = (seen < RARE * max(1.0, seen.sum() / RARE_IN)).reshape(SIZE, SIZE)
        self.known: dict[str, bool] = {}
        self.tokens: dict[str, bool] = {}

    def odd(self, words: list[str]) -> list[str]:
        """The words that hold a rare pair."""
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) > 400_000:
                known.clear()
                new = words
            at, starts = codes(new)
            rare = np.logical_or.reduceat(self.rare[at[:-1], at[1:]], starts)
            known.update(zip(new, rare.tolist()))
        return [w for w in words if known[w]]

    def any_odd(self, tokens: set[str]) -> bool:
        """Whether one of the tokens (words with what stands at them) holds an odd word."""
        known = self.tokens
        new = [t for t in tokens if t not in known]
        if new:
            if len(known) > 400_000:
                known.clear()
                new = list(tokens)
            words = [WORD.findall(t) for t in new]
            odd = set(self.odd(list({w for ws in words for w in ws})))
            known.update((t, not odd.isdisjoint(ws)) for t, ws in zip(new, words))
        return any([known[t] for t in tokens])

    def _scores(self, words: list[str]) -> np.ndarray:
        at, starts = codes(words)
        return np.add.reduceat(self.log[at[:-1], at[1:]], starts)

    def gains(self, old: list[str], new: list[str]) -> list[float]:
        """For each word the nats gained by the other in its place."""
        return (self._scores(new) - self._scores(old)).tolist() if old else []

    def gain(self, old: str, new: str) -> float:
        """Nats by which the words of ``new`` are likelier than those of ``old``."""
        a, b = set(WORD.findall(old)), set(WORD.findall(new))
        gone, come = sorted(a - b), sorted(b - a)
        return float((self._scores(come).sum() if come else 0.0) - (self._scores(gone).sum() if gone else 0.0))

    def _gains(self, words: list[str], turns: np.ndarray, pure: bool = False) -> np.ndarray:
        """Per pair of pages and word the nats gained by turning it; -inf where it
        cannot be turned (``pure``: or would mix Latin and Cyrillic)."""
        at, starts = codes(words)
        turned = turns[:, at]
        possible = np.logical_and.reduceat((turned >= 0)[:, :-1], starts, axis=1)
        turned = np.maximum(turned, 0)
        now = np.add.reduceat(self.log[turned[:, :-1], turned[:, 1:]], starts, axis=1)
        if pure:
            possible &= ~np.logical_or.reduceat(_MIXED[turned[:, :-1], turned[:, 1:]], starts, axis=1)
        return np.where(possible, now - self._scores(words), -np.inf)

    def turn(self, text: str) -> str:
        """The text with words put right that were read in a wrong single-byte page.

        The pair of pages under which words with rare pairs gain most is taken, if
        they gain enough; texts without such words are left alone.  Words that the
        model cannot tell do as the words around them.
        """
        words = list(dict.fromkeys(WORD.findall(text)))
        odd = [w for w in self.odd(words) if len(w) >= PROOF]
        if not odd:
            return text
        gains = self._gains(odd, _TURNS, pure=True)
        sure = np.where(gains > WORD_GAIN, gains, 0).sum(1)
        if sure.max() < TEXT_GAIN:
            return text
        near = np.argsort(-sure)[:CLOSE]
        near = near[sure[near] >= TEXT_GAIN]
        whole = self._gains(words, _TURNS[near])
        best = int(np.maximum(whole, 0).sum(1).argmax())
        gain = dict(zip(words, whole[best].tolist()))
        table = _TABLES[PAIRS[near[best]]]
        turned, kept = (whole[best] > WORD_GAIN).sum(), (whole[best] < -WORD_GAIN).sum()
        least = -UNSURE if turned > WHOLE_SHARE * (turned + kept) else 0.0
        found = [(m, gain[m.group()]) for m in WORD.finditer(text)]
        # 1: turned, 0: not, None: as what stands around it
        marks = [1 if g > least else None if g > -UNSURE else 0 for _, g in found]
        pieces, last, before = [], 0, None
        for k, (m, _) in enumerate(found):
            if marks[k] is None:
                after = next((x for x in marks[k + 1 :] if x is not None), None)
                turn = before in (1, None) and after in (1, None) and (before, after) != (None, None)
            else:
                turn = before = marks[k]
            if turn:
                pieces += [text[last : m.start()], m.group().translate(table)]
                last = m.end()
        return "".join(pieces) + text[last:]
