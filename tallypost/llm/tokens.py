"""Token ids of many texts at once, with a public vocabulary and the tokenizers library.

A text is cut into units at blanks, where the pre-tokenizers of both vocabularies always
end a piece, so the ids of a text are those of its units one after the other. With a byte-level
vocabulary a piece of letters also ends before a stop. Units repeat far more than texts: their
ids are kept in a direct-mapped table of fixed size.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from typing import Callable

import numpy as np

from .text import NOT_BLANK, U, Slice, span_hashes, words

SLOT_BITS, MOST_ENTRIES, MOST_IDS = 21, 1 << 20, 1 << 23
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

_LETTERS, _LETTERS_AFTER_SPACE = re.compile("[A-Za-z]+"), re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
# Signs that end a piece of letters; no apostrophe, which may begin a piece with letters.
_STOPS = ".,;:!?#$%&*"

_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# How byte-level vocabularies write bytes: those that cannot be seen as the characters from 256.
_AS_SIGNS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

# White space that is no ASCII blank, before a blank: there a unit may not end.
_JOINED = re.compile(
    rb"(?:[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)[\x20\x09-\x0d]"
)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Units:
    """Byte spans of units; text i has units [first[i], first[i + 1])."""

    def __init__(self, start: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.start, self.end, self.first = start, end, first


def word_units(s: Slice) -> Units:
    """Words alone: for a vocabulary that drops white space."""
    w = words(s, NOT_BLANK)
    return Units(w.start, w.end, w.first)


def _ends_letters(s: Slice, stop: np.ndarray) -> np.ndarray:
    """Places of the stops right behind an ASCII letter or one of two bytes from U+00C0 on."""
    at = np.flatnonzero(stop[s.data])
    at = at[at > 0]
    before = s.data[at - 1]
    lead = s.data[np.maximum(at - 2, 0)]
    folded = before | 0x20
    latin = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (at > 1)
    return at[((folded >= 0x61) & (folded <= 0x7A) & (before < 0x80)) | latin]


def blank_units(s: Slice, stop: np.ndarray | None = None) -> Units:
    """Words with the blanks before them, and blanks at the end: nothing is left out.

    With `stop`, a table of bytes, letters and what follows from such a byte on are units apart.
    """
    w = words(s, NOT_BLANK)
    # a unit ends where a word or a text that is not empty does
    ends = np.zeros(len(s.data) + 1, bool)
    ends[w.end] = True
    for m in _JOINED.finditer(s.data):
        ends[m.end() - 1] = False
    if stop is not None:
        ends[_ends_letters(s, stop)] = True
    ends[s.offsets[1:][np.diff(s.offsets) > 0]] = True
    end = np.flatnonzero(ends)
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    return Units(start, end, np.searchsorted(end, s.offsets, "right"))


def _signs(unit: str) -> str | None:
    if not _LETTERS_AFTER_SPACE.fullmatch(unit):
        return None
    return unit.replace(" ", "\u0120") if unit.isascii() else unit.encode().decode("latin-1").translate(_AS_SIGNS)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._plain = self._plain_form()
        self._stop = self._stops()
        self._clear()

    def _plain_form(self) -> Callable[[str], str | None]:
        """How the model itself takes a unit of ASCII letters: then the steps before it can be left out.

        Such a unit is one piece: its bytes as signs, also of Latin-1 letters, or in lower case.
        A form is used only if it gives the ids of the whole tokenizer on some examples.
        """
        forms = [
            _signs,
            lambda unit: unit.lower() if _LETTERS.fullmatch(unit) else None,
        ]
        for form in forms:
            examples = [u for u in (" the", "The", " Don", "shouting", " QED", "xqzjw", " \u00d6l\u00e0", "se\u00f1or\u00df\u00ff") if form(u)]
            if all(self._model_ids(form(u)) == self._tokenizer.encode(u, add_special_tokens=False).ids for u in examples):
                return form
        return lambda unit: None

    def _stops(self) -> np.ndarray | None:
        """Stops that always end a piece of letters, as a table of bytes; None if the vocabulary has no such rule.

        The byte-level pieces are ` ?\\p{L}+`, runs of other signs and so on. A sign of an added token,
        which is searched for in the text before that, is none.
        """
        step = self._tokenizer.pre_tokenizer
        rule = json.loads(step.__getstate__()) if step else {}  # its own part of the file
        if rule.get("type") != "ByteLevel" or rule.get("add_prefix_space") or not rule.get("use_regex", True):
            return None
        if self._tokenizer.normalizer:
            return None
        added = "".join(t.content for t in self._tokenizer.get_added_tokens_decoder().values())
        stop = np.zeros(256, bool)
        stop[[ord(c) for c in _STOPS if c not in added]] = True
        return stop

    def units(self, s: Slice) -> Units:
        """Units that leave nothing out, as small as the vocabulary allows."""
        return blank_units(s, self._stop)

    def encode(self, text: str):
        """The library's own encoding, with the place of every id."""
        return self._tokenizer.encode(text, add_special_tokens=False)

    def _model_ids(self, piece: str) -> list[int]:
        return [t.id for t in self._tokenizer.model.tokenize(piece)]

    def _clear(self) -> None:
        self._keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self._slot = np.full(1 << SLOT_BITS, -1, np.int32)
        self._first = np.zeros(1, np.int64)
        self._ids = np.zeros(0, np.uint32)
        self._pending: list[np.ndarray] = []

    def _learn(self, s: Slice, start: np.ndarray, end: np.ndarray) -> None:
        data = s.data.tobytes()
        texts = [data[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        pieces = list(map(self._plain, texts))
        others = [t for t, piece in zip(texts, pieces) if piece is None]
        rest = iter(self._tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else ())
        tokenize = self._tokenizer.model.tokenize
        got = [next(rest).ids if piece is None else [t.id for t in tokenize(piece)] for piece in pieces]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for ids in got for i in ids), np.uint32, int(sizes.sum()))
        self._ids = np.concatenate([self._ids, flat])
        self._first = np.concatenate([self._first, self._first[-1] + np.cumsum(sizes)])

    def entries(self, s: Slice, units: Units) -> np.ndarray:
        """For each unit the number of its entry, good until the next call."""
        if len(self._first) > MOST_ENTRIES or len(self._ids) > MOST_IDS:
            self._clear()
        h = span_hashes(s.data, units.start, units.end)
        slot = (h >> U(64 - SLOT_BITS)).astype(np.int64)
        entry = self._slot[slot].astype(np.int64)
        new = np.flatnonzero((self._keys[slot] != h) | (entry < 0))
        if len(new):
            fresh, at, which = np.unique(h[new], return_index=True, return_inverse=True)
            base = len(self._first) - 1
            self._learn(s, units.start[new[at]], units.end[new[at]])
            entry[new] = base + which
            place = slot[new[at]]
            self._keys[place] = fresh
            self._slot[place] = base + np.arange(len(fresh))
        return entry

    def counts(self, s: Slice, units: Units) -> np.ndarray:
        """Number of ids of each unit."""
        entry = self.entries(s, units)
        return self._first[entry + 1] - self._first[entry]

    def ids(self, s: Slice, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other (uint32), and how many each text has."""
        entry = self.entries(s, units)
        first = self._first[entry]
        sizes = self._first[entry + 1] - first
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self._ids[np.repeat(first - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[units.first]
        return flat, np.diff(bounds)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path)
