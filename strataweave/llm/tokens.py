"""Exact ids of the public tokenizers file, with a cache of word pieces in front of the library.

The file's normaliser and pre-tokenizer never join characters across ASCII white space, so a text's ids are the ids of
its white-space chunks in order. A chunk of Latin letters, digits and ASCII punctuation needs no normalisation besides
lower case; its pieces go to the library's own BPE model. Any other chunk goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

END_ID = 2
#: Entries a worker's cache of chunks may hold, and its cache of pieces.
CACHE_ENTRIES, PIECE_ENTRIES = 300_000, 600_000

_LETTERS = "a-zß-öø-ÿ"
_PIECES = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+").fullmatch
_encoders: dict[str, "Encoder"] = {}


def byte_symbols() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Encoder(dict):
    """chunk (bytes) -> its ids as little-endian uint16 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 65536:
            raise ValueError("ids over 65535 do not fit two bytes")
        self.model = self.library.model
        self.symbols = byte_symbols()
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if chunk.isalpha():  # ASCII letters
            ids = self._piece(text.lower())
        elif chunk[:-1].isalpha() and text[-1] in ".,":
            ids = self._piece(text[:-1].lower()) + self._piece(text[-1])
        elif _PLAIN(text) and "<|" not in text:
            ids = b"".join(map(self._piece, _PIECES.findall(text.lower())))
        else:
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if len(self) < CACHE_ENTRIES and len(chunk) < 64:
            self[chunk] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            symbols = piece if piece.isascii() else "".join([self.symbols[b] for b in piece.encode()])
            ids = array("H", [t.id for t in self.model.tokenize(symbols)]).tobytes()
            if len(self.pieces) < PIECE_ENTRIES and len(piece) < 64:
                self.pieces[piece] = ids
        return ids

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text (null: empty), with the end id, as uint16."""
        chunks = (text or "").encode("utf-8").split()
        return np.frombuffer(b"".join([*map(self.__getitem__, chunks), b"\x02\x00"]), "<u2")


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
