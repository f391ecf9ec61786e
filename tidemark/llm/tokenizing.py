"""Exact, memoised use of the public tokenizers inside tasks.

Encoding a whole text costs far more than looking up its words. Texts made of
Latin characters are cut at places where the tokenizer cuts as well, and each
distinct piece is encoded once per worker; every other text goes through the
library whole, so that results are the library's in both cases.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Characters on which the standard library and the tokenizer agree about case,
#: white space and normal form, and on which Unicode versions don't differ.
LATIN = r"\x20-\x7e\xa1-ɏ‐-‧‰-⁞€"
#: A memo is emptied when it holds so many entries.
MEMO_ENTRIES = 400_000


def byte_alphabet() -> list[str]:
    """Byte -> character of byte-level BPE: printable bytes stand for themselves,
    the others for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class WordEncoder:
    """Token ids of texts for a lower-casing word BPE, as little-endian uint32 bytes."""

    ODD = re.compile(rf"[^\t-\r\x85\xa0{LATIN}]")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.alphabet = byte_alphabet()
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        shown = "".join([self.alphabet[b] for b in word.encode()])
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        if len(self.words) >= MEMO_ENTRIES:
            self.words.clear()
        self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        words = self.words
        ids = b"".join([words.get(w) or self._word(w) for w in self.pieces(chunk)])
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        self.memo[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if "<|" in text or self.ODD.search(text):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            return b"".join([i.to_bytes(4, "little") for i in found])
        memo, chunk = self.memo, self._chunk
        return b"".join([memo.get(c) or chunk(c) for c in text.lower().split()])


class BytePieces:
    """Pre-token frequencies of a text and piece counts of a pre-token for a byte-level BPE."""

    ODD = re.compile(rf"[^\n{LATIN}]")
    SPECIAL = "<|endoftext|>"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.alphabet = byte_alphabet()
        self.units: dict[str, list[str]] = {}
        self.counts: dict[str, int] = {}

    def _unit(self, unit: str) -> list[str]:
        if len(self.units) >= MEMO_ENTRIES:
            self.units.clear()
        found = self.units[unit] = self.cut(" " + unit)
        return found

    def frequencies(self, text: str) -> dict[str, int]:
        """Pre-token -> occurrences. A single space between two other characters
        always begins a pre-token, so what lies between such spaces is cut once."""
        from collections import Counter

        if self.SPECIAL in text:
            parts = text.split(self.SPECIAL)
            total = Counter({self.SPECIAL: len(parts) - 1})
            for part in parts:
                total.update(self.frequencies(part))
            return total
        if self.ODD.search(text):
            return Counter(text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
            return Counter(self.cut(text))
        first, *rest = text.split(" ")
        out: dict[str, int] = {}
        for p in self.cut(first):
            out[p] = out.get(p, 0) + 1
        units, cut = self.units, self._unit
        for unit, n in Counter(rest).items():
            for p in units.get(unit) or cut(unit):
                out[p] = out.get(p, 0) + n
        return out

    def count(self, pretoken: str) -> int:
        n = self.counts.get(pretoken)
        if n is None:
            if pretoken == self.SPECIAL:
                n = len(self.tokenizer.encode(pretoken, add_special_tokens=False).ids)
            else:
                n = len(self.model.tokenize("".join([self.alphabet[b] for b in pretoken.encode()])))
            if len(self.counts) >= MEMO_ENTRIES:
                self.counts.clear()
            self.counts[pretoken] = n
        return n


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=4)
def byte_pieces(path: str) -> BytePieces:
    return BytePieces(path)
