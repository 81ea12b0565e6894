"""Exact library encoding of whole texts with a cache of text chunks.

Neither tokenizer's pre-tokens reach across the chunk borders used here, so the ids of a text are the ids of its chunks in turn.
A worker keeps at most ``CACHE`` chunks of at most ``LONGEST`` characters, and only while its tasks use the encoder.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

from ._common import frees

CACHE, LONGEST = 600_000, 64
_ODD = re.compile(r"\s\s|\A\s|\s\Z")
_INNER = re.compile(r"(?<=\S) (?=\S)")
_CONTROL = re.compile("[\\x1c-\\x1f]")
_SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: The pre-token patterns of the two tokenizer files.
PATTERNS = {
    "bytes": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "words": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: The same over Latin-1 alone, letters first (no other branch can start where that one does).
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = {
    "bytes": rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+",
    "words": rf"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^\s{_L}{_N}]+",
}
_made: dict[tuple[str, str], ChunkEncoder] = {}


def spaced(text: str) -> list[str]:
    """The runs of a text between Unicode white space (the control characters 1C-1F are not white space here)."""
    if _CONTROL.search(text):
        return [x for x in _SPACES.split(text) if x]
    return text.split()


class Cache(dict):
    """Makes a missing value by a function. When full, the later half goes: what came first is what comes often."""

    def __init__(self, make, limit: int = CACHE):
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        if len(self) >= self.limit:
            keep = dict(islice(self.items(), self.limit // 2))
            self.clear()
            self.update(keep)
        value = self[key] = self.make(key)
        return value


class ChunkEncoder:
    """``style`` "bytes": byte-level pre-tokens that may start with one space. "words": white space is dropped, case too.

    A Latin-1 text is cut into its pre-tokens, and the library encodes each new one. Other texts are cut at single spaces or
    white space; a chunk with letters that normalisation could change (from U+0250), or special strings, goes whole to the library.
    """

    def __init__(self, path: str, style: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.style = style
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        pattern = PATTERNS[style]
        self.cut = regex.compile(pattern).findall
        self.latin = re.compile(LATIN[style]).findall
        self.pieces = Cache(self.ids)
        self.bare = Cache(self.chunk, CACHE // 8)
        self.led = Cache(lambda x: self.chunk(" " + x), CACHE // 8)  # of " " + chunk

    def ids(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, text: str) -> bytes:
        if not text or max(text) >= "\u0250" or "<|" in text:
            return self.ids(text)
        return b"".join([self.pieces[x] for x in self.cut(text.lower() if self.style == "words" else text)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        bare, led, pieces, out = self.bare.__getitem__, self.led.__getitem__, self.pieces.__getitem__, []
        for t in texts:
            if plain(t):
                out.append(b"".join(map(pieces, self.latin(t.lower() if self.style == "words" else t))))
            elif self.style == "words":
                out.append(b"".join(map(bare, spaced(t))))
            else:
                x = _INNER.split(t) if _ODD.search(t) else t.split(" ")
                out.append(bare(x[0]) + b"".join(map(led, x[1:])))
        return out


def plain(text: str) -> bool:
    """Latin-1 alone, without special strings and the control characters that only Python takes for white space."""
    if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return False
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def encoder(path: str, style: str) -> ChunkEncoder:
    """One for each worker and file."""
    if (path, style) not in _made:
        _made[path, style] = ChunkEncoder(path, style)
    return _made[path, style]


@frees("tokenize")
def forget() -> None:
    """Frees the worker's encoders."""
    _made.clear()
