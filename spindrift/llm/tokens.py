"""Whole-text tokenisation with a per-process cache of white-space chunks.

The tokenizers library cuts at white space before it merges, so a text's ids are the ids of its chunks in turn;
each distinct chunk is encoded once by the library and remembered. Only spaces and line feeds are cut here, which
every pre-tokeniser of that kind drops; other white space stays inside a chunk and is left to the library. A chunk
not seen before is cut once more where a letter meets closing ASCII punctuation (a boundary of the pre-tokeniser as
well) and, where the file's normaliser lower-cases, looked up in lower case, so that the library merges each word
form once.
"""

from __future__ import annotations

import json
import os
import sys
from array import array

import numpy as np

from .common import CACHES, forget_others

#: Chunks that a worker remembers before it starts again; bounds its memory at some 100 MB.
CACHE_ENTRIES = 400_000
#: Longer chunks are encoded but not remembered.
CACHE_CHARS = 64
#: Closing punctuation that the pre-tokeniser keeps together and apart from letters; the apostrophe starts suffixes and is left out.
CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder(dict):
    """Maps a chunk to its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        # both shortcuts are taken only with the word-splitting, lower-casing kind of file that they are exact for
        parts = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (parts.get("normalizer") or {}).get("normalizers", [])]
        splits = [x["type"] for x in (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_form = sys.byteorder == "little" and steps == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"]
        self.model = self.tokenizer.model
        # byte-level alphabet by its public rule: printable bytes stand for themselves, the others follow U+0100
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}
        self[""] = b""

    def form(self, chunk: str) -> bytes | None:
        """Ids by way of the chunk's plainer form, if it has one."""
        if "<" in chunk:  # may hold a special token
            return None
        word = chunk.rstrip(CLOSING)
        # (other letters may end in a mark, once normalised, that joins what follows)
        if word and len(word) < len(chunk) and word[-1].isalpha() and word[-1] < "\u0250" and word[-1] != "\u0130":
            return self[word] + self[chunk[len(word) :]]
        # Latin letters up to U+024F change case one by one and are already composed
        if max(chunk) < "\u0250" and "\u0130" not in chunk and (lower := chunk.lower()) != chunk:
            return self[lower]
        # a lower-case word of such letters is one pre-token, which the model merges as it is
        if max(chunk) < "\u0250" and chunk.isalpha() and chunk.islower():
            word = chunk if chunk.isascii() else "".join(map(self.alphabet.__getitem__, chunk.encode()))
            return array("I", [x.id for x in self.model.tokenize(word)]).tobytes()
        return None

    def __missing__(self, chunk: str) -> bytes:
        ids = self.form(chunk) if self.by_form else None
        if ids is None:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self[""] = b""
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: none) as little-endian uint32 bytes."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


_ENCODERS: dict[str, ChunkEncoder] = {}
CACHES["tokens"] = _ENCODERS.clear


def encoder(path: str) -> ChunkEncoder:
    """The process's encoder for a tokenizer file; its path is valid on every executor."""
    forget_others("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
