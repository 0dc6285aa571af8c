"""Texts to token ids with the tokenizers library, word by word.

A byte-level BPE cuts a text into stretches by a pattern before it merges anything, and always cuts before a single space
that a non-space follows; a line feed between two non-spaces is a stretch of its own. So a text can be taken apart there, and
the ids of a word are looked up or, when new, come from the library's BPE model, stretch by stretch. Added tokens are cut out first, as the library does. The library is never
given a long text whole, which would take it a hundred bytes and more for each byte.
"""

from __future__ import annotations

from struct import Struct, pack

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

DEFAULT = public_tokenizers.path("byte_bpe_50k.json")
#: Words of up to WORD characters that are remembered for good in a Python worker once they have come twice; about 200 bytes
#: each. Longer ones are encoded each time.
REMEMBERED, WORD = 400_000, 64
#: New words are remembered until there are so many, and then forgotten together.
RECENT = 200_000
END_MARKS = frozenset(".,;:!?")
#: A space that begins a stretch, as a non-space is behind it.
FIRM = regex.compile(r" (?=\S)")
PACK = [Struct(f"<{n}I").pack for n in range(65)]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Loose(Exception):
    """White space other than single spaces and line feeds between non-spaces."""


class Encoder:
    """encode(text) gives ids as little-endian unsigned 32-bit integers. path: a tokenizer file."""

    def __init__(self, path: str = DEFAULT):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.largest = max(self.whole.get_vocab(with_added_tokens=True).values())
        self.letters = byte_letters()
        self.space = self.letters[32]
        self.cut = regex.compile(public_tokenizers.PATTERN)
        self.words: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        added = self.whole.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take their surroundings are not provided for")
        self.added = {t.content: pack("<I", i) for i, t in added.items()}
        self.cut_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if added else None

    def stretch(self, text: str) -> bytes:
        """Ids of what the pattern does not cut."""
        return self.merged(text.encode().decode("latin-1").translate(self.letters))

    def merged(self, letters: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(letters)]
        return PACK[len(ids)](*ids) if len(ids) < 65 else pack("<%dI" % len(ids), *ids)

    def word(self, word: str) -> bytes:
        """Ids of a word without white space, behind a space."""
        out = self.recent.get(word)
        if out is not None:
            if len(self.words) < REMEMBERED:
                self.words[word] = out
            return out
        if word.isalpha():
            out = self.merged(self.space + word) if word.isascii() else self.stretch(" " + word)
        elif word.split() != [word]:
            raise Loose
        elif word[-1] in END_MARKS and (core := word[:-1]).isalpha():
            known = self.words.get(core)
            out = (self.word(core) if known is None else known) + self.plain(word[-1])
        else:
            out = b"".join(map(self.stretch, self.cut.findall(" " + word)))
        if len(word) <= WORD:
            if len(self.recent) >= RECENT:
                self.recent.clear()
            self.recent[word] = out
        return out

    def head(self, word: str) -> bytes:
        """Ids of what stands before the first space of a line."""
        out = self.heads.get(word)
        if out is None:
            if word.split() != [word]:
                raise Loose
            out = self.cut_up(word)
            if len(word) <= WORD:
                if len(self.heads) >= RECENT:
                    self.heads.clear()
                self.heads[word] = out
        return out

    def cut_up(self, text: str) -> bytes:
        return b"".join(map(self.stretch, self.cut.findall(text)))

    def plain(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self.stretch(mark)
        return self.marks[mark]

    def encode(self, text: str) -> bytes:
        if self.added and any(t in text for t in self.added):
            out, at = [], 0
            for m in self.cut_added.finditer(text):
                out += [self.between(text[at : m.start()]), self.added[m.group()]]
                at = m.end()
            return b"".join([*out, self.between(text[at:])])
        return self.between(text)

    def between(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text:
            return b""
        known, out = self.words.get, []
        try:
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                ids = list(map(known, rest))
                if None in ids:
                    ids = [self.word(w) if x is None else x for w, x in zip(rest, ids, strict=True)]
                out.append(b"".join([self.head(first), *ids]))
            return self.plain("\n").join(out)
        except Loose:
            first, *rest = FIRM.split(text)
            return b"".join([self.cut_up(first), *(known(w) or self.cut_up(" " + w) for w in rest)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str = DEFAULT) -> Encoder:
    """One encoder for each Python worker and file; workers live on between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
