"""BPE encoding and decoding by a traversal of a trie of distinct words.

BPE has two properties over a word's symbols. Any prefix of an encoding encodes its own characters; and a row of tokens is an
encoding when each neighbouring pair is (when merging the pair's symbols gives the pair again). So the last token of a
prefix's encoding is the one token ending there that goes together with the last token of what stands before it. A trie of
the distinct words has each shared prefix once; a depth-first walk carries the last tokens of the path and finds one more a
node. Walking back over them gives the ids of any word.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import islice

from pyspark.sql import DataFrame

from ._common import frees, steps, task, texts_of
from .tokenize import LATIN, plain, spaced

#: Words a worker keeps, of at most ``KEPT`` letters; a word past ``LONG`` letters is walked alone.
CACHE, KEPT, LONG, PAIRS = 600_000, 64, 256, 400_000
_END = ""  # a trie node's key for "a word ends here"
_made: dict[str, TrieEncoder] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else one past 255 in turn."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class TrieEncoder:
    """Encodes and decodes by the vocabulary, merges and special strings of a tokenizer file with word ends ("</w>")."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {tuple(p): i for i, p in enumerate(pairs)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.text = {i: t for t, i in self.vocab.items()} | {i: t for t, i in special.items()}
        cut = len(self.mark)
        self.final = {t[:-cut]: i for t, i in self.vocab.items() if t.endswith(self.mark) and len(t) > cut}
        self.inner = {t: i for t, i in self.vocab.items() if not (t.endswith(self.mark) and len(t) > cut)}
        self.longest = max(map(len, [*self.final, *self.inner]))
        self.letters = byte_letters()
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.cut_special = re.compile("(" + "|".join(map(re.escape, special)) + ")").split
        self.made = {a + b: (a, b) for a, b in self.ranks}
        self.edges: dict[tuple[int, bool], list[tuple[str, int, int]]] = {}
        self.unmade = {i for i in self.vocab.values() if self.merge(self.symbols(i)) != [self.marked(i)]}
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.ids = {t: array("I", [i]).tobytes() for t, i in special.items()}
        self.tokens = {t: t for t in special}
        self.latin = re.compile(LATIN["words"]).findall

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE; only used once for each token, to find those that cannot come out."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def marked(self, token: int) -> str:
        return self.text[token]

    def symbols(self, token: int) -> list[str]:
        t = self.text[token]
        if t.endswith(self.mark) and len(t) > len(self.mark):
            t = t[: -len(self.mark)]
            return [*t[:-1], t[-1] + self.mark]
        return list(t)

    def edge(self, token: int, left: bool) -> list[tuple[str, int, int]]:
        """The symbols that stand at a token's left or right edge while it is merged: symbol, rank it is made at, rank it goes at."""
        known = self.edges.get((token, left))
        if known is None:
            known, symbol, gone = [], self.marked(token), 1 << 60
            while True:
                parts = self.made.get(symbol)
                known.append((symbol, self.ranks[parts] if parts else -1, gone))
                if not parts:
                    break
                symbol, gone = parts[0 if left else 1], self.ranks[parts]
            self.edges[token, left] = known
        return known

    def together(self, left: int, right: int) -> bool:
        """Whether merging the pair's symbols gives the pair again: no merge across the border comes first while its two
        symbols stand there (of equal ranks the one to the left comes first). left is -1 at a word's start."""
        known = right not in self.unmade and (left < 0 or left not in self.unmade)
        if known and left >= 0:
            for a, a_from, a_to in self.edge(left, False):
                for b, b_from, b_to in self.edge(right, True):
                    rank = self.ranks.get((a, b))
                    if rank is not None and rank < a_to and rank <= b_to and max(a_from, b_from) < min(a_to, b_to):
                        known = False
        if len(self.pair_ok) > PAIRS:
            self.pair_ok.clear()
        self.pair_ok[left, right] = known
        return known

    def last_token(self, table: dict[str, int], tail: str, depth: int, last: list[int]) -> tuple[int, int]:
        """The token that ends a prefix of ``depth`` symbols whose last ones are ``tail``, and where it starts: the one that goes
        together with the last token of what stands before it (``last`` by length)."""
        known = self.pair_ok.get
        base = depth - len(tail)
        for at in range(base, depth):
            t = table.get(tail[at - base :])
            if t is not None and ((ok := known((last[at], t))) or ok is None and self.together(last[at], t)):
                return t, at
        raise ValueError(f"no token of the vocabulary ends {tail!r}")

    def trace(self, token: int, at: int, last: list[int], starts: list[int]) -> list[int]:
        ids = [token]
        while at > 0:
            ids.append(last[at])
            at = starts[at]
        ids.reverse()
        return ids

    def encode_long(self, word: str) -> list[int]:
        """One word as a path of its own: a trie of it would share nothing and hold a node for each letter."""
        last, starts, longest = [-1], [0], self.longest
        for depth in range(1, len(word)):
            t, at = self.last_token(self.inner, word[max(0, depth - longest) : depth], depth, last)
            last.append(t)
            starts.append(at)
        return self.trace(*self.last_token(self.final, word[-longest:], len(word), last), last, starts)

    def encode_words(self, words: list[str]) -> None:
        """Ids of distinct words (of byte letters) by one walk over their trie, into self.words."""
        root: dict = {}
        for w in words:
            if len(w) > LONG:
                self.words[w] = self.encode_long(w)
                continue
            node = root
            for c in w:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            node[_END] = w
        last, starts = [-1] * 2, [0] * 2
        stack = [(node, 1, c) for c, node in root.items()]
        known, final, inner, longest = self.pair_ok.get, self.final.get, self.inner.get, self.longest
        while stack:
            node, depth, prefix = stack.pop()
            del last[depth:], starts[depth:]
            first = depth - longest if depth > longest else 0
            word = node.get(_END)
            if word is not None:
                for at in range(first, depth):
                    t = final(prefix[at:])
                    if t is not None and ((ok := known((last[at], t))) or ok is None and self.together(last[at], t)):
                        break
                else:
                    raise ValueError(f"no token of the vocabulary ends {word!r}")
                self.words[word] = self.trace(t, at, last, starts)
                if len(node) == 1:
                    continue
            for at in range(first, depth):
                t = inner(prefix[at:])
                if t is not None and ((ok := known((last[at], t))) or ok is None and self.together(last[at], t)):
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends {prefix!r}")
            last.append(t)
            starts.append(at)
            for c, below in node.items():
                if c:
                    stack.append((below, depth + 1, prefix + c))

    def cut(self, text: str) -> list[str]:
        """The normalised pre-tokens of a text, special strings among them."""
        if plain(text):
            return self.latin(text.lower())
        out = []
        for part in self.cut_special(text):
            if part in self.special:
                out.append(part)
            else:
                for chunk in spaced(part):
                    out += self.pieces(chunk.lower() if chunk.isascii() else self.normalize(chunk))
        return out

    def learn(self, pieces: list[str]) -> None:
        """Ids and token strings of new pre-tokens, by one trie of them all."""
        spelt = [p if p.isascii() and p.isprintable() else "".join([self.letters[b] for b in p.encode()]) for p in pieces]
        self.words = {}
        self.encode_words(spelt)
        text, found = self.text, self.words
        for p, w in zip(pieces, spelt, strict=True):
            ids = found[w]
            self.ids[p] = array("I", ids).tobytes()
            self.tokens[p] = " ".join([text[i] for i in ids])
        self.words = {}

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Each text's ids (little-endian uint32) and what they decode to: token strings joined by spaces."""
        split = [self.cut(t) for t in texts]
        need = set().union(*split)
        missing = [x for x in need if x not in self.ids]
        if len(self.ids) + len(missing) > CACHE:  # what came first is what comes often: the later half goes
            self.ids = dict(islice(self.ids.items(), CACHE // 2))
            self.tokens = dict(islice(self.tokens.items(), CACHE // 2))
            missing = [x for x in need if x not in self.ids]
        if missing:
            self.learn(missing)
        ids, tokens = self.ids.__getitem__, self.tokens.__getitem__
        out = [(b"".join(map(ids, x)), " ".join(map(tokens, x))) for x in split]
        for x in missing:
            if len(x) > KEPT:
                del self.ids[x], self.tokens[x]
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.text[i] for i in ids)


def trie_encoder(path: str) -> TrieEncoder:
    """One for each worker and file."""
    if path not in _made:
        _made[path] = TrieEncoder(path)
    return _made[path]


@frees("trie")
def forget() -> None:
    """Frees the worker's encoders."""
    _made.clear()


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32), decoded, a row for each row; a null text counts as empty.

    Only a map: no shuffle, and no key that could be hot. Special strings in a text become their special ids, as in the library.
    """

    def run(batches):
        import pyarrow as pa

        enc = trie_encoder(tokenizer)
        for ids, texts in steps(batches):
            coded = enc.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(b) // 4 for b, _ in coded], pa.int64()), pa.array([b for b, _ in coded], pa.binary()), pa.array([t for _, t in coded], pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return texts_of(df, id_col, text_col).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(task(run, "trie"), "doc_id long, n_tokens long, ids binary, decoded string")
