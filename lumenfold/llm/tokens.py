"""Token ids of whole texts, as little-endian unsigned 32-bit bytes.

Ids are those of the given tokenizer file. A blank between two characters that aren't white space is always the
start of a token, so a text falls into pieces there; the ids of a piece are kept in a table of bounded size, and
the tokenizer's own BPE model encodes those that aren't in it. A text in which the string of an added token stands is
left to the tokenizer as a whole, which gives that string the token's id.
"""

from __future__ import annotations

import string
import struct
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

from lumenfold.llm.held import held

#: Entries of an encoder's table of pieces at most, some 0.3 kB each; the one of words inside pieces has a fifth.
PIECES = 150_000
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: The byte-level pre-tokenizer's pattern and the bytes that its alphabet keeps as they are.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_BYTES = (range(33, 127), range(161, 173), range(174, 256))
#: White space to some pattern engines only, and letters beyond Latin, whose tables may differ between Unicode
#: versions: texts with these go to the whole tokenizer.
UNSURE = regex.compile("[\x1c-\x1f\x85\u0250-\U0010ffff]").search
#: Runs of these at a word's end are one match of the pattern.
MARKS = string.punctuation


def _alphabet() -> dict[int, int]:
    kept = {b for r in KEPT_BYTES for b in r}
    table, free = {}, 256
    for b in range(256):
        table[b] = b if b in kept else free
        free += b not in kept
    return table


class TextEncoder:
    """ids of a text as bytes, equal to those of the tokenizer without the special tokens that it would add."""

    def __init__(self, path: str, pieces: int = PIECES):
        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.has_added = regex.compile("|".join(map(regex.escape, added))).search if added else lambda text: None
        self.model = self.whole.model
        # Words that come again are kept here; the model's own table, where it has one, takes more time than it saves.
        getattr(self.model, "_resize_cache", lambda size: None)(0)
        self.tokenize = self.model.tokenize
        self.find = regex.compile(PATTERN).findall
        self.alphabet = _alphabet()
        self.pieces = Pieces(self._learnt, pieces)
        self.words: dict[str, bytes] = {}  # what the pattern finds inside other pieces
        self.most_words = max(1, pieces // 5)
        self.line = self._coded(self._mapped("\n"))

    def _by_library(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.most_words:
                self.words.clear()
            found = self.words[word] = self._coded(self._mapped(word))
        return found

    def _mapped(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.alphabet)

    def _coded(self, mapped: str) -> bytes:
        ids = [t.id for t in self.tokenize(mapped)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if UNSURE(text):
            return self._by_library(text)
        return b"".join(map(self._word, self.find(text)))

    def _learnt(self, piece: str) -> bytes | None:
        """Ids of a blank and the piece; None if no boundary is certain there."""
        known = self.pieces
        # A word, or one with a comma, a full stop or other marks, which is most of them.
        word = piece if piece.isalpha() else piece.rstrip(MARKS)
        if word.isalpha() and (piece.isascii() or not UNSURE(piece)):
            packed = known.get(word)
            if packed is None:
                ids = [t.id for t in self.tokenize("Ġ" + (word if word.isascii() else self._mapped(word)))]
                packed = PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)
            if word == piece:
                return packed
            known[word] = packed
            return packed + self._word(piece[len(word) :])
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        # A line's end between two characters that aren't white space is a match by itself.
        head, line, tail = piece.partition("\n")
        if line and not head[-1].isspace() and not tail[0].isspace() and not UNSURE(piece):
            return known[head] + self.line + (self._word(tail) if tail.isalpha() else self._plain(tail))
        return self._plain(" " + piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.has_added(text):
            return self._by_library(text)
        first, *rest = text.split(" ")
        if not rest or first[-1:].isspace():
            return self._plain(text)
        try:
            return self._plain(first) + b"".join(map(self.pieces.__getitem__, rest))
        except TypeError:
            return self._plain(text)


class Pieces(dict):
    """A table that learns what it is asked for, and begins anew when it is full."""

    def __init__(self, learn: Callable[[str], bytes | None], limit: int):
        self.learn, self.limit = learn, limit

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) >= self.limit:
            self.clear()
        found = self[piece] = self.learn(piece)
        return found


def encoder(path: str, pieces: int = PIECES) -> TextEncoder:
    """One a worker process, of the tokenizer used last."""
    return held(("encoder", path, pieces), lambda: TextEncoder(path, pieces))
