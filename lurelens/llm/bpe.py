"""Merges of a byte-level BPE vocabulary for single pre-tokens.

The vocabulary's own library does the merging; only its per-text overhead
(normalising, splitting, offsets) is left out for pre-tokens already cut.
"""

from __future__ import annotations

from functools import cache


def byte_alphabet() -> str:
    """The printable character that byte-level vocabularies write for each
    byte: itself where it is visible Latin-1, else the next free from U+0100."""
    out, free = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return "".join(out)


class Merger:
    """Token ids of one pre-token at a time."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._model = self.tokenizer.model
        self._letters = dict(enumerate(byte_alphabet()))

    def ids(self, word: bytes) -> list[int]:
        text = word.decode("latin-1")
        return [t.id for t in self._model.tokenize(text if word.isalpha() else text.translate(self._letters))]

    def whole(self, text: str) -> list[int]:
        """The library's ids of a text, special strings as by default."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids


@cache
def merger(path: str) -> Merger:
    """One a process: kept over the tasks that a worker runs."""
    return Merger(path)
