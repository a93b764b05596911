"""Token ids of whole texts, by the public tokenizers, with a memo of pieces.

Neither vocabulary merges over the pieces that its pre-tokenizer makes, so a text's ids are
those of its pieces in a row. Natural text repeats its pieces: a worker keeps the ids of
those it has met and asks the tokenizer's BPE model only for new ones. Texts whose pieces
can't be told by a byte pattern (odd white space, marks outside ASCII) go through the
tokenizer whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Sequence

import numpy as np

#: White space outside ASCII, and ASCII separators that bytes.split doesn't know.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_ASCII = re.compile(r"[\x00-\x7f]+")
#: Pieces of a text whose characters outside ASCII are all letters, with white space as part of them.
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9\x80-\xff]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: ASCII that is neither letter, digit, white space, full stop nor comma.
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,")
_TWO_STOPS = re.compile(rb"[.,][.,]")
#: Entries of a generation of the memo; the one before it is kept, so frequent pieces stay.
MEMO_ENTRIES = 500_000
_coders: dict[tuple[str, bool], Coder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be
    printed, else the next free one from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in printed else next(rest)) for b in range(256)}


class Coder:
    """ids as little-endian unsigned 32-bit bytes. ``spaces``: the vocabulary sees white space."""

    def __init__(self, path: str, spaces: bool, entries: int = MEMO_ENTRIES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.spaces = spaces
        self.entries = entries
        self.memo: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[bytes] | None:
        """What the ids are looked up by; None: only the tokenizer can tell."""
        ascii_ = text.isascii()
        if _ODD_SPACE.search(text) or not (ascii_ or _ASCII.sub("", text).isalpha()):
            return None
        raw = text.encode()
        if self.spaces:
            return _PIECES.findall(raw)
        raw = raw.lower()  # the vocabulary has lower case only; this folds ASCII, the tokenizer the rest
        if len(raw.translate(None, _MARKS)) == len(raw) and not _TWO_STOPS.search(raw):  # lone stops are pieces
            raw = raw.replace(b",", b" , ").replace(b".", b" . ")
        return raw.split()

    def _meet(self, pieces: set[bytes]) -> None:
        """Have the ids of all these pieces in the memo."""
        new = pieces.difference(self.memo)
        if len(self.memo) + len(new) > self.entries:
            self.before, self.memo, new = self.memo, {}, pieces
        memo, model, letters, rest = self.memo, self.model, self.letters, []
        for c in new:
            if c in self.before:
                memo[c] = self.before[c]
            elif self.spaces or c.isalpha() or c == b"." or c == b",":  # one piece in ASCII
                memo[c] = b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(c.decode("latin1").translate(letters))])
            else:
                rest.append(c)
        if rest:
            words = [c.decode() for c in rest]
            fold = self.tokenizer.normalizer.normalize_str
            for c, w in zip(rest, words, strict=True):
                if w.isalpha() and (folded := fold(w)).isalpha():  # else it is several pieces
                    memo[c] = b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(folded.encode().decode("latin1").translate(letters))])
            rest = [c for c in rest if c not in memo]
            memo.update(zip(rest, self._whole([c.decode() for c in rest]), strict=True))

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; null is the empty text."""
        out: list[bytes] = []
        for k in range(0, len(texts), 256):
            part = [t or "" for t in texts[k : k + 256]]
            pieces = [self._pieces(t) for t in part]
            self._meet({c for x in pieces if x for c in x})
            get = self.memo.__getitem__
            out += [self._whole([t])[0] if x is None else b"".join(map(get, x)) for t, x in zip(part, pieces, strict=True)]
        return out


def coder(path: str, spaces: bool, entries: int = MEMO_ENTRIES) -> Coder:
    """One for each worker and vocabulary: later tasks of the worker use its memo."""
    made = _coders.setdefault((path, spaces), None) or Coder(path, spaces)
    made.entries = entries
    _coders[path, spaces] = made
    return made


def end_mark(end_id: int) -> bytes:
    return struct.pack("<I", end_id)
