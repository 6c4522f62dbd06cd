"""Encoders over public vocabularies.

The sentence model never merges across a space between two other characters: none of its pieces holds the space mark
after another character, which is verified when it is loaded. Such spaces are proven stable boundaries. Parts between
them are encoded once and their counts kept in a bounded cache.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import numpy as np

CACHE = 800_000
_INNER_SPACE = re.compile("(?<=[^\\s\u2581]) (?=[^\\s\u2581])")
_ODD_SPACE = re.compile(r"\s | \s")
_SPACE_RUN = re.compile(r"\s\s|\s$|\s\Z")
_BEYOND_LATIN = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")


def split_parts(text: str) -> list[str]:
    """Cut at every single space between two characters that are neither white space nor the model's space mark."""
    if "\u2581" in text or _ODD_SPACE.search(text) or text[:1] == " " or text[-1:] == " ":
        return _INNER_SPACE.split(text)
    return text.split(" ")


def stable_boundaries(text: str, a: int, b: int) -> list[int]:
    """Positions of text inside (a, b) of single spaces between two characters that are neither white space nor the model's
    space mark."""
    return [m.start() for m in _INNER_SPACE.finditer(text, a, b) if a < m.start() < b - 1]


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.clear()
        out = self.make(key)
        if len(key) < 256:
            self[key] = out
        return out


class ByteEncoder:
    """Ids of the byte-level vocabulary as packed little-endian uint32, equal to those of the tokenizers library."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Strings that the library takes for one token wherever they stand in a text; such texts go to the library.
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.removesuffix(".json") + ".tiktoken", "rb"))}
        # Where no two white-space characters meet and none ends the text, the pattern's look-ahead changes nothing;
        # without it the pattern runs on a plain automaton.
        plain = public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", "")
        self.plain, self.exact = (
            tiktoken.Encoding(name, pat_str=pat, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
            for name, pat in (("plain", plain), ("exact", public_tokenizers.PATTERN))
        )

    def encode(self, text: str) -> bytes:
        # Character classes of the two libraries agree on Latin text; anything else goes to the tokenizers library.
        if not text.isascii() and _BEYOND_LATIN.search(text) or any(t in text for t in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
        elif _SPACE_RUN.search(text):
            ids = self.exact(text)
        else:
            ids = self.plain(text)
        return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


class PieceCounter:
    """Numbers of sentence-model pieces of a text, part by part."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        inner = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if mark in p.lstrip(mark)]
        if inner:
            raise ValueError(f"pieces such as {inner[0]!r} cross spaces; boundaries would not be stable")
        # a part left empty by a space at the very end of a text is that space's mark alone
        self.cache = _Cache(lambda part: len(self.model.encode(part)) if part else 1)

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.cache.__getitem__, split_parts(text)))


    def begins(self, text: str) -> list[int]:
        """The character at which each token of the text begins."""
        pieces = self.model.encode(text, return_type="proto").pieces
        if text.isascii():
            return [p.begin for p in pieces]
        # the library counts bytes
        at = np.cumsum([0, *(1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in text)])
        return (np.searchsorted(at, [p.begin for p in pieces], "right") - 1).tolist()


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)
