"""Token ids of whole texts with a public byte-level BPE file of the ``tokenizers`` library.

A byte-level vocabulary never merges across the place before a space that a letter, digit or mark follows, so a text is cut
there, every different piece of a batch (told by a 64-bit hash) is looked up once, and the ids are gathered with numpy. A text in
which a space is followed by another white-space or unusual character is encoded as a whole. Pieces seen before are remembered up to
``REMEMBERED`` per worker.

Where the file's only cut is the library's byte-level one, a piece of letters with marks behind it is two words of that cut;
each goes to the library's merge model directly, so "word" and "word," share their work.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np

from .words import EXACT, Words, words_of

REMEMBERED = 1_000_000
_NO_SPACE = np.ones(256, bool)
_NO_SPACE[32] = False
_BEGINNING = np.uint64(0x5851F42D4C957F2D)
_PLAIN = re.compile("[!-~¡-ᙿ]")
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏЀ-ҁ]+)([!-&(-/:-@\[-`{-~]*)")  # letters, then marks other than the apostrophe
_OWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that byte-level BPE shows as themselves
_SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_OWN))}
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        assert sys.byteorder == "little" and array("I").itemsize == 4
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        made = json.loads(self.tokenizer.to_str())
        cut, model = made["pre_tokenizer"] or {}, made["model"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] and not made["normalizer"]
        plain = plain and all(t["special"] for t in made["added_tokens"])
        plain = plain and model["type"] == "BPE" and not (model["dropout"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"])
        self.model = self.tokenizer.model if plain else None
        self.known: dict[str, bytes] = {}  # words and marks
        self._forget()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without an end id."""
        raw = [t.encode() for t in texts]
        bounds = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        pieces = words_of(data, bounds, _NO_SPACE, EXACT)
        key = pieces.hash.copy()
        begins = pieces.first[:-1][pieces.counts > 0]
        key[begins] ^= _BEGINNING  # the text's beginning has no space before it
        different, where, which = np.unique(key, return_index=True, return_inverse=True)
        entry = self._entries(different, where, np.isin(where, begins), data, pieces)[which]
        size = self.size[entry]
        total = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.at[entry] - total[:-1], np.maximum(size, 0))]
        spaces = np.concatenate(([0], np.cumsum(data == 32)))[bounds]
        odd = np.concatenate(([0], np.cumsum(size < 0)))[pieces.first]
        # Two spaces in a row, a space at an end or an unusual piece: such a text is encoded whole.
        whole = (np.diff(odd) > 0) | ((np.diff(spaces) != pieces.counts - 1) & (np.diff(bounds) > 0))
        cut = total[pieces.first]
        return [self._encode([t])[0] if w else ids[a:b].tobytes() for t, w, a, b in zip(texts, whole, cut, cut[1:], strict=False)]

    def _entries(self, keys: np.ndarray, where: np.ndarray, begins: np.ndarray, data: np.ndarray, pieces: Words) -> np.ndarray:
        """Places of different pieces in the tables of ids; new ones are learned."""
        if len(self.entry) > REMEMBERED:
            self._forget()
        out = np.fromiter((self.entry.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        new = np.flatnonzero(out < 0)
        if len(new):
            spans = zip(pieces.start[where[new]].tolist(), pieces.end[where[new]].tolist(), begins[new].tolist(), strict=True)
            texts = [(" " if first else "") + data[a:b].tobytes().decode() for a, b, first in spans]
            known = self._learned(set(texts))
            found = [known[t] for t in texts]
            lengths = np.array([-1 if f is None else len(f) // 4 for f in found])
            flat = np.frombuffer(b"".join(f for f in found if f), "<u4")
            out[new] = np.arange(len(self.size), len(self.size) + len(new))
            self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)))
            self.size, self.flat = np.concatenate((self.size, lengths)), np.concatenate((self.flat, flat))
            self.entry.update(zip(keys[new].tolist(), out[new].tolist(), strict=True))
        return out

    def _forget(self) -> None:
        self.entry: dict[int, int] = {}  # by hash
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _learned(self, wanted: set[str]) -> dict[str, bytes | None]:
        """Ids of pieces; None for those whose text must be encoded whole."""
        if len(self.known) > REMEMBERED // 2:
            self.known.clear()
        rest, made = self._without_words(wanted)
        fit = [p for p in rest if p[:1] == " " or _PLAIN.match(p)]
        made.update(zip(fit, self._encode([p[1:] if p[0] == " " else " " + p for p in fit]), strict=True))
        return made | dict.fromkeys(set(rest).difference(fit))

    def _without_words(self, new: set[str]) -> tuple[list[str], dict[str, bytes | None]]:
        """The pieces that are not letters and marks; ids of those that are."""
        if self.model is None:
            return list(new), {}
        words = {p: m.groups() for p in new if (m := _WORD.fullmatch(p))}
        parts = {h for h, _ in words.values()} | {" " + t for _, t in words.values() if t}
        for p in parts.difference(self.known):
            text = p[1:] if p[0] == " " else " " + p
            found = self.model.tokenize(text.encode().decode("latin-1").translate(_SHOWN))
            self.known[p] = array("I", [t.id for t in found]).tobytes()
        made = {p: self.known[head] + self.known[" " + tail] if tail else self.known[head] for p, (head, tail) in words.items()}
        return list(new.difference(words)), made

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 20_000):
            for e in self.tokenizer.encode_batch_fast(texts[i: i + 20_000], add_special_tokens=False):
                out.append(array("I", e.ids).tobytes())
        return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
