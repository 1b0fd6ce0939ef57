"""Exact tokenization of whole texts by pieces between which no vocabulary merge can reach.

All three vocabularies break a text where a space follows a character that is no white space: no pre-token and no merge
rule spans that place. Texts are cut there, equal pieces are given to the library once, and the ids of a text are the
ids of its pieces in order. ``tests/llm/test_tokens.py`` holds this against the libraries on whole texts.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

#: Pieces in each of the two generations that a worker remembers. Speed only.
CACHE_PIECES = 500_000
#: Longer pieces are not remembered.
LONG_PIECE = 64

_ENCODERS: dict = {}
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")


def _no_threads() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def split_spaced(text: str) -> list[str]:
    """Pieces that keep the white space before them: cut before a space or line feed that follows a non-space."""
    if "\x00" in text:
        return [text]
    parts = text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")
    if not parts[0]:
        del parts[0]
    return parts


def segments(text: str, size: int = 1_000_000, keep_space: bool = True) -> list[str]:
    """A long text in parts of about ``size`` characters, cut at a space between two plain characters."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size and (m := _SAFE.search(text, start + size)):
        out.append(text[start : m.start()])
        start = m.start() if keep_space else m.end()
    return [*out, text[start:]]


def join_open(parts: list[str]) -> list[str]:
    """Join every piece that ends in white space to the next one: a run of white space is never cut."""
    out: list[str] = []
    held = ""
    for p in parts:
        held += p
        if not held[-1:].isspace():
            out.append(held)
            held = ""
    if held:
        out.append(held)
    return out


def _byte_table() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_BYTES = _byte_table()
#: Pre-token patterns of the two byte-level vocabularies (fixed values).
_CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
_WITH_SPACE = rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+"
_WITHOUT = rf"{_CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+"
#: Signs that are a pre-token of their own after a word and at the end of a piece.
_SIGNS = tuple(".,!?;:")
#: Pre-tokens are found here only in texts below this character; in others by the library.
_LATIN_END = "\u0250"


class SpacedEncoder:
    """A tokenizers file with byte-level BPE: the library's model encodes each distinct pre-token once."""

    def __init__(self, path: str, keep_spaces: bool):
        _no_threads()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep_spaces = keep_spaces
        self.find = regex.compile(_WITH_SPACE if keep_spaces else _WITHOUT).findall
        self.tokenize = self.tokenizer.model.tokenize
        self.known = Recent(self.told)

    def told(self, piece: str) -> bytes | None:
        """None for a piece that ends in white space: its ids depend on what follows."""
        if piece.isascii() and self.keep_spaces:  # plain words, also before one sign, the way ``one`` takes them
            body = piece[1:] if piece[:1] == " " else piece
            if body.isalpha():
                return array("H", [t.id for t in self.tokenize("\u0120" + body if body is not piece else piece)]).tobytes()
            if body[-1:] in _SIGNS and body[:-1].isalpha():
                return self.known[piece[:-1]] + self.known[piece[-1]]
        return None if self.keep_spaces and piece[-1:].isspace() else self.one(piece)

    def pieces(self, text: str) -> list[str]:
        return split_spaced(text) if self.keep_spaces else text.replace("\n", " ").split(" ")

    def word(self, w: str) -> bytes:
        if w.isascii() and w.isalnum():
            signs = w
        elif w[1:].isascii() and w[1:].isalnum() and w[0] == " ":
            signs = "\u0120" + w[1:]
        else:
            signs = w.encode().decode("latin-1").translate(_BYTES)
        return array("H", [t.id for t in self.tokenize(signs)]).tobytes()

    def one(self, piece: str) -> bytes:
        """Ids of a piece that ends in no white space, or of a whole text."""
        if not piece.isascii() and max(piece) >= _LATIN_END or "<|" in piece and any(s in piece for s in self.specials):
            return array("H", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if not self.keep_spaces:
            piece = (piece.lower() if piece.isascii() else self.tokenizer.normalizer.normalize_str(piece)).strip(" ")
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():
            return self.word(piece)
        if body[-1:] in _SIGNS and body[:-1].isalpha():
            return self.known[piece[:-1]] + self.known[body[-1]]
        return b"".join(map(self.word, self.find(piece)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers; null is empty."""
        out, ids = [], self.known.__getitem__
        for t in texts:
            got = []
            for part in segments(t) if t else []:
                pieces = self.pieces(part)
                try:
                    got.append(b"".join(map(ids, pieces)))
                except TypeError:  # a piece ends in white space
                    got.append(b"".join([self.known[p] or self.one(p) for p in join_open(pieces)]))
                self.known.settle()
            out.append(b"".join(got))
        return out


class Recent(dict):
    """Results by piece, found when first asked for. Two generations keep about the pieces used last."""

    def __init__(self, find, keep: int = CACHE_PIECES):
        super().__init__()
        self.find, self.keep, self.old = find, keep, {}

    def __missing__(self, piece: str):
        got = self.old.get(piece)
        if got is None:
            got = self.find(piece)
        if got is not None and len(piece) <= LONG_PIECE:
            self[piece] = got
        return got

    def settle(self) -> None:
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()


class PieceCounter:
    """Counts of a sentencepiece model that keeps white space and puts one space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known = Recent(lambda p: len(self.model.encode(p)), CACHE_PIECES)

    def pieces(self, text: str) -> list[str]:
        """Cut at each single space after a non-space; that space is the one the model adds to a piece."""
        text = text.replace("▁", " ")  # the model's own sign for a space
        body = text.rstrip(" ")
        parts = body.split(" ")
        if "  " in body or body[:1] == " ":
            out, held = [], 0
            for p in parts:
                if p:
                    out.append(" " * held + p)
                    held = 0
                else:
                    held += 1
            parts = out
        if len(body) < len(text):
            tail = text[len(body) :]
            if parts and body:
                parts[-1] += tail
            else:
                parts = [tail]
        return parts

    def count(self, texts: list[str | None]) -> list[int]:
        if any(t and len(t) > 2_000_000 for t in texts):
            return [sum(self.count_uncut([s])[0] for s in segments(t, keep_space=False)) if t else 0 for t in texts]
        return self.count_uncut(texts)

    def count_uncut(self, texts: list[str | None]) -> list[int]:
        """Counts of texts of any length: a long one without a place to cut is counted as a whole."""
        known = self.known
        split = [self.pieces(t) if t else [] for t in texts]
        new = [p for p in set(chain.from_iterable(split)).difference(known) if known.old.get(p) is None]
        long = {}
        for i in range(0, len(new), 4096):
            batch = new[i : i + 4096]
            for piece, ids in zip(batch, self.model.encode(batch, num_threads=1), strict=True):
                (known if len(piece) <= LONG_PIECE else long)[piece] = len(ids)
        get = known.__getitem__
        out = [sum([long.get(p) or get(p) for p in parts] if long else map(get, parts)) for parts in split]
        known.settle()
        return out


def encoder(kind: type, *args):
    """One encoder for each worker process: its pieces stay known from task to task."""
    if (kind, args) not in _ENCODERS:
        _ENCODERS[kind, args] = kind(*args)
    return _ENCODERS[kind, args]
