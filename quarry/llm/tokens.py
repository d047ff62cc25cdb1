"""Token ids of whole texts by a public tokenizer file, with a cache of word pieces.

Text is cut where the tokenizer's own first step is sure to cut: before a single space or line feed
between characters that are no white space (or at any of them, where a tokenizer drops white
space). Ids of such pieces don't depend on their neighbours, so each piece is encoded once and then
looked up. Other texts, and those that hold the string of an added token such as ``<|endoftext|>``,
are encoded whole. Either way the ids are those of encoding the whole text with the library's own
settings and ``add_special_tokens=False``.
"""

from __future__ import annotations

import sys
from array import array
from functools import cache

CACHE_PIECES = 800_000  # pieces remembered in a Python worker, in each of two generations


def _plain(text: str) -> bool:
    """Whether single spaces and line feeds within the text are its only white space."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n":
        return False
    return text.replace("\n", "").isprintable()  # no other white space, control or format character


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: byte to character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


def _packed(ids: list[int]) -> bytes:
    got = array("I", ids)
    if sys.byteorder == "big":
        got.byteswap()
    return got.tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.normalizer = self.whole.normalizer
        kind = str(self.whole.pre_tokenizer)
        self.spaced = self.normalizer is None  # a word's leading space belongs to its piece
        added = self.whole.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]  # found in the raw text, before it is cut
        self.cuts = "ByteLevel" in kind and not any(t.normalized for t in added)
        self.letters = _byte_letters()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return _packed(self.whole.encode(text, add_special_tokens=False).ids)

    def _word(self, piece: str) -> bytes:
        """A piece's ids: by the model alone if the piece is one word of letters."""
        core = piece[1:] if piece[:1] == " " else piece
        if len(core) > 1 and core[-1] in ".," and core[:-1].isalpha():
            return self._piece(piece[:-1]) + self._piece(piece[-1])
        if not core.isalpha() or not core.isascii() and not self.spaced:
            return self._ids(piece)
        if not self.spaced:
            word = core.lower()
        elif piece.isascii():
            word = piece.replace(" ", self.letters[32])
        else:
            word = piece.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(word)])

    def _piece(self, piece: str) -> bytes:
        got = self.new.get(piece)
        if got is None:
            got = self.old.pop(piece, None)
            self.new[piece] = got = self._word(piece) if got is None else got
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.new) > CACHE_PIECES:
            self.old, self.new = self.new, {}
        out, get, piece = [], self.new.get, self._piece
        for text in texts:
            if not self.cuts or self.spaced and not _plain(text) or any(t in text for t in self.added):
                out.append(self._ids(text))
                continue
            if self.spaced:
                pieces = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            else:
                pieces = text.replace("\n", " ").split(" ")
            ids = list(map(get, pieces))
            if None in ids:
                ids = [piece(p) if x is None else x for p, x in zip(pieces, ids, strict=True)]
            out.append(b"".join(ids))
        return out


@cache
def encoder(path: str) -> Encoder:
    """One encoder a Python worker and file; it stays for the worker's later tasks."""
    return Encoder(path)
