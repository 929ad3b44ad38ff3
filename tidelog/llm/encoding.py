"""Token ids of whole texts by a public tokenizer file, each distinct piece encoded once.

The byte-level tokenizer cuts a text into pieces by a pattern and encodes each
piece on its own, so a text's ids are its pieces' ids in order. Pieces are kept
in a cache of two generations: what is used moves to the younger one, which
becomes the older one when it is full. Only pieces that neither holds go to the
tokenizers library. A text that holds the
string of a special token is given to the library whole, and so are all texts
where the file cuts by another pattern or changes texts before.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Pieces of one generation of the cache; there are two at most.
GENERATION = 200_000

# The tokenizer file's cutting pattern, for texts of ASCII and Latin-1 letters and for all others.
_NARROW = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WIDE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters for which both patterns agree: no superscript digits, fractions or unusual spaces.
_PLAIN = re.compile("[^\t\n\r -~¡-©«-±´-¸»¿-ÿ]")


def _byte_table() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible in Latin-1, else one from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b and b != 173]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_table()


def byte_characters(piece: str) -> str:
    """A piece as the tokenizer's model takes it, a character for each byte."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", _BYTES[32])
    return piece.encode().decode("latin-1").translate(_BYTES)


def cuts_alike(path: str) -> bool:
    """Whether the tokenizer of the file cuts texts by the pattern above and encodes each piece alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    own = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    return own and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")


class Pieces(dict):
    """The ids of pieces, those of unseen ones from the tokenizer's model."""

    def __init__(self, model, older: dict[str, bytes]):
        self.tokenize, self.older = model.tokenize, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", [t.id for t in self.tokenize(byte_characters(piece))]).tobytes()  # 4 bytes, little-endian
        self[piece] = ids
        return ids


class Encoder:
    """``encode_all`` gives the ids of texts as little-endian unsigned 32-bit integers, without an end id."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = regex.compile(_WIDE)
        self.alike, self.model = cuts_alike(path), self.tokenizer.model
        self.pieces = Pieces(self.model, {})

    def encode(self, text: str) -> bytes:
        if not self.alike or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.pieces) > GENERATION:
            self.pieces.older = {}
            self.pieces = Pieces(self.model, self.pieces)
        return b"".join(map(self.pieces.__getitem__, (self.wide if _PLAIN.search(text) else _NARROW).findall(text)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and file, so that its cache lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
