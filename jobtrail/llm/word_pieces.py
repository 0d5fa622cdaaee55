"""Ids of single words under a word-level BPE vocabulary of the tokenizers library.

White space separates words before the merges and is dropped, and the
normaliser acts inside words, so a text's ids are its words' ids in order.
"""

from __future__ import annotations

import os

import numpy as np

# ASCII marks that follow a word; none starts a contraction or a special token.
MARKS = ".,!?;:&*$%#"
# Letters below this code point need no composition and lower-case to themselves or one letter.
SIMPLE_LETTERS = 0x250
CACHED_WORDS = 250_000
CACHED_LENGTH = 48


def split_words(text: str) -> list[str]:
    """Pieces between spaces, tabs and line ends; other white space stays inside for the tokenizer to drop."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte as a visible character."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordPieces(dict):
    """Word -> its ids as little-endian bytes of ``dtype``; remembers a bounded number of words."""

    def __init__(self, path: str, dtype: str = "<u4"):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = dtype
        self.cores: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _core(self, core: str) -> bytes | None:
        """Ids of a run of simple letters by the merges alone; None where the whole tokenizer is needed."""
        if not core.isalpha() or (not core.isascii() and max(core) >= chr(SIMPLE_LETTERS)):
            return None
        low = core.lower()
        found = self.cores.get(low)
        if found is None:
            if not low.isalpha():
                return None
            plain = low if low.isascii() else "".join(self.letters[b] for b in low.encode())
            found = self._pack([t.id for t in self.tokenizer.model.tokenize(plain)])
            if len(low) <= CACHED_LENGTH:
                if len(self.cores) >= CACHED_WORDS:
                    self.cores.clear()
                self.cores[low] = found
        return found

    def _whole(self, word: str) -> bytes:
        return self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode_word(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        first = self._core(core) if core else b""
        if first is None:
            return self._whole(word)
        marks = word[len(core):]
        if not marks:
            return first
        tail = self.cores.get(marks)
        if tail is None:
            tail = self._whole(marks)
            if len(marks) <= CACHED_LENGTH:
                self.cores[marks] = tail
        return first + tail

    def __missing__(self, word: str) -> bytes:
        ids = self.encode_word(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, split_words(text)))

    def forget(self) -> None:
        """Give back the words' memory; the vocabulary stays for the worker's next task."""
        self.clear()
        self.cores.clear()


_loaded: dict[tuple[str, str], WordPieces] = {}


def word_pieces(path: str, dtype: str = "<u4") -> WordPieces:
    """One encoder per Python worker, kept between tasks."""
    if (path, dtype) not in _loaded:
        _loaded[path, dtype] = WordPieces(path, dtype)
    return _loaded[path, dtype]
