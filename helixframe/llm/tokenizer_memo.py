"""Exact token ids from a public tokenizer, with a bounded memo of recurring chunks.

Both vocabularies used here split a text before byte-pair merging, and no pre-token spans a place where a text is
cut into chunks, so the ids of a text are those of its chunks in order; the library encodes a chunk once per worker.
"""

from __future__ import annotations

import os
import re
from array import array

from helixframe.llm.common import kept_in_worker

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks a worker remembers; beyond it the memo starts anew (bounded memory, same results).
MEMO_CHUNKS = 900_000

#: ASCII punctuation that makes a pre-token of its own after a word (without those of contractions and special tokens).
PUNCTUATION = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 upwards."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Memo(dict):
    """Chunk -> stored value; ``learn`` encodes what is new.

    A word of Latin letters is one pre-token, which goes straight to the library's merge model; a word with closing
    punctuation is composed of its two pre-tokens; any other chunk passes through the whole library.
    """

    def __init__(self, tokenizer, value, lead: str = "", folded: bool = False) -> None:
        super().__init__()
        self.tokenizer, self.value, self.lead, self.folded = tokenizer, value, lead, folded
        self.merge = tokenizer.model.tokenize
        self.tails: dict = {}  # apart from the chunks: punctuation alone takes the blank before it

    def _word(self, word: str):
        """The stored value of a word of letters below U+0250 (all of them stable under NFC)."""
        if self.folded:
            word = word.lower()
        letters = self.lead + word
        letters = letters.replace(" ", _LETTERS[32]) if letters.isascii() else letters.encode().decode("latin-1").translate(_LETTERS)
        return self.value([t.id for t in self.merge(letters)])

    def values_of(self, chunks: list[str], sound: bool = False) -> list | None:
        """The stored values; with ``sound``, None if a chunk is empty or has white space at its ends."""
        found = list(map(self.get, chunks))
        if None in found:
            if len(self) > MEMO_CHUNKS:
                self.clear()
            new = {x for x, v in zip(chunks, found, strict=True) if v is None}
            if sound and any(not x or x[0].isspace() or x[-1].isspace() for x in new):
                return None
            self._learn(new)
            found = [self[x] if v is None else v for x, v in zip(chunks, found, strict=True)]
        return found

    def _learn(self, new: set[str]) -> None:
        other = []
        for chunk in new:
            head = chunk.rstrip(PUNCTUATION)
            if head.isalpha() and max(head) < "\u0250" and head.lower().isalpha():
                value = self.get(head)
                if value is None:
                    value = self._word(head)
                self[chunk] = value if len(head) == len(chunk) else value + self._tail(chunk[len(head) :])
            else:
                other.append(chunk)
        if other:
            encoded = self.tokenizer.encode_batch_fast([self.lead + x for x in other], add_special_tokens=False)
            self.update((chunk, self.value(e.ids)) for chunk, e in zip(other, encoded, strict=True))

    def _tail(self, tail: str):
        value = self.tails.get(tail)
        if value is None:
            if len(self.tails) > MEMO_CHUNKS:
                self.tails.clear()
            value = self.tails[tail] = self.value(self.tokenizer.encode(tail, add_special_tokens=False).ids)
        return value


class WordIds:
    """Ids under a vocabulary that drops white space and case: chunks are cut at any ASCII white space."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.memo = _Memo(Tokenizer.from_file(path), lambda ids: array("I", ids).tobytes(), folded=True)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [b"".join(self.memo.values_of(self._chunks(t))) for t in texts]

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if "<|" not in text:  # a special token's string is told apart by its case
            text = text.encode().lower().decode()  # A-Z only
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class ByteCounts:
    """Token counts under a byte-level vocabulary: the blank before a word belongs to the word's token.

    A text is cut at single blanks between two characters that are not white space: always pre-token boundaries.
    """

    _BLANK = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.first, self.rest = _Memo(tokenizer, len), _Memo(tokenizer, len, " ")

    def __call__(self, texts: list[str]) -> list[int]:
        return [self._count(t) for t in texts]

    def _count(self, text: str) -> int:
        head, *rest = text.split(" ")
        counts = None if head[:1].isspace() or head[-1:].isspace() or not head else self.rest.values_of(rest, sound=True)
        if counts is None:
            head, *rest = self._BLANK.split(text)
            counts = self.rest.values_of(rest, sound=True)
        if counts is None:  # white space at the text's end is not for the memo
            counts = [len(e.ids) for e in self.first.tokenizer.encode_batch_fast([" " + x for x in rest], add_special_tokens=False)]
        return self.first.values_of([head])[0] + sum(counts)


def encoder(kind: type, path: str):
    """One encoder per Python worker, kept between tasks until another operator keeps something."""
    return kept_in_worker((kind, path), lambda: kind(path))
