"""Exact encoding with the ``tokenizers`` library, remembering the ids of whole chunks between white space.

Both vocabularies used here split a text into pre-tokens before merging.  No pre-token runs from a character that is
not white space into one that is, nor from a letter into an ASCII digit or sign.  A text can therefore be cut at such
places, and each distinct chunk encoded once: prose repeats most of its chunks.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable

#: Unicode White_Space, as the vocabularies' patterns read ``\s``.
WHITE = "\t-\r\x20\x85\xa0  -     　"
#: Letters whose byte-level form and lower case need no context, and ASCII characters that no letter run contains.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
NOT_LETTER = "!-@\\[-`{-~"
#: Bytes that an encoder's remembered chunks take at most, about: two generations of half of it each.
MOST_BYTES = 160 << 20
#: What an entry takes beside the characters of its chunk and the bytes of its ids.
ENTRY_BYTES = 190
#: Characters; longer chunks are encoded but not remembered.
LONG_CHUNK = 64


def byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: bytes that print stand for themselves, the others for code points from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(rest)}


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lowered(text: str) -> str:
    """A-Z lower-cased where no mark can follow that composes with small letters only; otherwise the text itself."""
    try:
        return text.encode("latin-1").translate(_LOWER).decode("latin-1")
    except UnicodeEncodeError:
        return text


class Remembered(dict):
    """Chunk -> ids, learned on demand, in two generations: a full one takes the place of the one before it, and what is
    met again moves back, so that what a text keeps using stays whatever came first."""

    def __init__(self, learn: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.learn, self.most, self.size = learn, most, 0
        self.before: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.learn(chunk)
        if len(chunk) <= LONG_CHUNK:
            cost = ENTRY_BYTES + len(ids) + len(chunk) * (1 if chunk.isascii() else 4)
            if 2 * (self.size + cost) > self.most:
                self.before = dict(self)
                self.clear()
                self.size = 0
            self.size += cost
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """``encode([text])[0]`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` as little-endian unsigned 32-bit bytes.

    keeps_space: the vocabulary encodes white space (then it leads the chunk after it); otherwise white space is
    dropped and letters are lower-cased.  A chunk of letters alone is one pre-token and goes straight to the merges of
    the library's model; every other chunk takes the library's whole way.
    As with the library's default, the strings of special tokens stand for these tokens; what is between them is encoded on its own.
    """

    def __init__(self, path: str, keeps_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # for chunks, whose letters may have been lowered; ``encode`` cuts out special tokens before
        self.merge = self.tokenizer.model.tokenize
        self.keeps_space = keeps_space
        ends = f"(?=[{NOT_LETTER}{WHITE}])"
        if keeps_space:
            chunk = f"[ ]?[{LETTER}]+{ends}|\n(?=[{LETTER}])|[{WHITE}]*[^{WHITE}{LETTER}]*[{LETTER}]+{ends}|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"
        else:
            chunk = f"[{LETTER}]+{ends}|[^{WHITE}{LETTER}]*[{LETTER}]+{ends}|[^{WHITE}]+"
        self.chunks = re.compile(chunk).findall
        self.is_word = re.compile(f"[ ]?[{LETTER}]+" if keeps_space else f"[{LETTER}]+").fullmatch
        other = byte_letters()
        self.letter_of = [chr(other.get(b, b)) for b in range(256)].__getitem__
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("only added tokens that are taken as they stand can be cut out of a text")
        self.special = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        self.cut = re.compile(f"({'|'.join(map(re.escape, self.special))})").split
        self.known = Remembered(self._learn, MOST_BYTES)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, chunk: str) -> bytes:
        if len(chunk) <= LONG_CHUNK:
            word = chunk if self.keeps_space else chunk.lower()
            if chunk.isascii() and word.removeprefix(" ").isalpha():  # plain letters stand for themselves
                return array("I", [t.id for t in self.merge(word.replace(" ", "\u0120"))]).tobytes()
            if self.is_word(chunk):
                return array("I", [t.id for t in self.merge("".join(map(self.letter_of, word.encode())))]).tobytes()
        return array("I", self._ids(chunk)).tobytes()

    def _one(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.chunks(text if self.keeps_space else lowered(text))))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out = []
        for text in texts:
            if any(s in text for s in self.special):
                out.append(b"".join(self.special[p] if p in self.special else self._one(p) for p in self.cut(text)))
            else:
                out.append(self._one(text))
        return out


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(name: str, keeps_space: bool) -> ChunkEncoder:
    """One encoder for each Python worker; name: a file of the public tokenizers, or a path."""
    if (name, keeps_space) not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[name, keeps_space] = ChunkEncoder(name if os.path.isabs(name) else public_tokenizers.path(name), keeps_space)
    return _ENCODERS[name, keeps_space]


def forget() -> None:
    """Give up what this worker's encoders remember; for operators that need its memory for something else."""
    for enc in _ENCODERS.values():
        enc.known = Remembered(enc._learn, MOST_BYTES)


WORD_BPE = ("word_bpe_49k.json", False)
BYTE_BPE = ("byte_bpe_50k.json", True)
