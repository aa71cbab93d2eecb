"""Token ids by the tokenizers library, with a bounded memo of white-space-delimited chunks.

A chunk is a run of ASCII white space with the run of other bytes after it. Both tokenizers used here split before
every white space that follows something else, so the ids of a text are the ids of its chunks in order; only chunks
not met before are encoded. A new chunk of plain letters, with ASCII punctuation after it or not, is exactly one
piece for each of the two before byte-pair merging; those pieces go to the library's model without its normaliser
and splitter. Other chunks go through the whole tokenizer; texts with any other white-space character go whole, as do
texts that hold the string of an added token such as <|endoftext|>, which the library gives its own id.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import cached_property
from itertools import compress, islice, repeat
from operator import is_

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core

from tokenizers import Tokenizer  # noqa: E402

_CHUNK = re.compile(rb"\s*\S+|\s+")  # in bytes: x20 and x09-x0D
#: 1C-1F, and U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000 as UTF-8
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: What each of these begins with, to be looked for first.
_RARE = (b"\x1c", b"\x1d", b"\x1e", b"\x1f"), (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: one line feed or none, one space or none, letters (A-Z, a-z, U+00C0-00FF without the two signs), ASCII punctuation without the apostrophe
_PLAIN = re.compile(rb"(\n?)(\x20?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
_PUNCTUATION = bytes(sorted({*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)} - {0x27}))
KEEP, _LONGEST = 1_000_000, 64  # chunks in a worker's memo, about 160 bytes each; longest chunk kept


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level merges: itself, or the next free code point from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


def _has_other_space(text: bytes) -> bool:
    ascii_, more = _RARE
    if not any(x in text for x in ascii_) and (text.isascii() or not any(x in text for x in more)):
        return False
    return _OTHER_SPACE.search(text) is not None


class Encoder:
    """Whole texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, end: int, words: bool = False, keep: int = KEEP):
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.tokenizer.encode_special_tokens = True  # for texts without such strings, as lower case may bring one forth
        self.model = Tokenizer(self.tokenizer.model)
        self.letters = _byte_letters()
        self.keep = keep
        self.memo: dict[bytes, bytes] = {}  # chunk -> code
        self.end = end.to_bytes(4, "little")
        self.words = words  # the tokenizer drops white space and case
        self.split = bytes.split if words else _CHUNK.findall

    @cached_property
    def plain(self) -> Tokenizer:
        """As the library has it; loaded for the first text that holds an added token's string, as few do."""
        return Tokenizer.from_file(self.path)

    @staticmethod
    def _packed(found: list) -> list[bytes]:
        out = []
        for e in found:
            ids = array("I", e.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            out.append(ids.tobytes())
        return out

    def _whole(self, chunks: list[bytes], by: Tokenizer | None = None) -> list[bytes]:
        return self._packed((by or self.tokenizer).encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False))

    def _shown(self, piece: bytes) -> str:
        """A piece as the model's merges have it."""
        if piece.isascii():  # printable as it is, but for a space or line feed before it
            text = piece.decode("ascii")
            return text if text.isalpha() else text.translate(self.letters)
        if self.words:
            piece = piece.decode().lower().encode()
        return piece.decode("latin-1").translate(self.letters)

    def _new(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Codes of distinct chunks that the memo lacks."""
        out: dict[bytes, bytes] = {}
        pieces: dict[bytes, bytes | None] = {b"": b""}
        parts: list[tuple] = []
        fresh, odd = [], []
        known, blank = self.memo.get, 0 if self.words else 1  # a chunk of the byte-level tokenizer begins with a space, mostly
        for c in chunks:
            core = c.rstrip(_PUNCTUATION)
            if core[blank:].isalpha() and (self.words or core[0] == 0x20):  # what _PLAIN finds, for ASCII letters
                if core is c:
                    if c not in pieces:
                        pieces[c] = None
                        fresh.append(c)
                    continue
                own = core, c[len(core) :]
            else:
                m = _PLAIN.fullmatch(c)
                if m is None or c[:2] == b"\n ":
                    odd.append(c)
                    continue
                own = m.groups()
            parts.append((c, own))
            for p in own:
                if p not in pieces:
                    pieces[p] = known(p)
                    if pieces[p] is None:
                        fresh.append(p)
        if fresh:
            found = self.model.encode_batch_fast(list(map(self._shown, fresh)), add_special_tokens=False)
            pieces.update(zip(fresh, self._packed(found), strict=True))
            out.update((p, pieces[p]) for p in fresh if len(p) <= _LONGEST or p in chunks)
        for c, own in parts:
            out[c] = b"".join(map(pieces.__getitem__, own))
        if odd:
            out.update(zip(odd, self._whole(odd), strict=True))
        return out

    def ids(self, text: bytes | None) -> bytes:
        """The ids of a whole text and the end id."""
        if not text:
            return self.end
        if any(x in text for x in self.added):
            return self._whole([text], self.plain)[0] + self.end
        if self.words:
            text = text.lower()  # A-Z only
        elif _has_other_space(text):
            return self._whole([text])[0] + self.end
        return self.join(self.split(text))

    def join(self, chunks: list[bytes]) -> bytes:
        """The ids of chunks (lower-case where `words`) and the end id."""
        memo = self.memo
        codes = list(map(memo.get, chunks))
        if None not in codes:
            return b"".join(codes) + self.end
        missing = list(compress(range(len(codes)), map(is_, codes, repeat(None))))
        words = [chunks[i] for i in missing]
        found = self._new(set(words))
        for i, c in zip(missing, words, strict=True):
            codes[i] = found[c]
        out = b"".join(codes) + self.end
        memo.update(found)
        for c in found:
            if len(c) > _LONGEST:
                del memo[c]
        if len(memo) > self.keep:  # the older half holds the common ones
            self.memo = dict(islice(memo.items(), self.keep // 2))
        return out


_OPEN: dict[tuple, Encoder] = {}


def encoder(path: str, end: int, words: bool = False, keep: int = KEEP) -> Encoder:
    """One encoder for each Python worker, so that its memo outlives a task."""
    key = (path, end, words, keep)
    if key not in _OPEN:
        _OPEN[key] = Encoder(path, end, words, keep)
    return _OPEN[key]
