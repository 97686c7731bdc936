"""Byte-level BPE over Arrow text columns.

The pre-tokenizer's pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
is evaluated with array operations on the bytes of many texts at once; each
distinct piece is then encoded once per chunk.  Texts with characters whose
class the byte tables do not hold, with contractions, or with a special token
go through the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from .common import slices, spans_to_index

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Two-byte characters up to U+023F are classified here; texts with others are left to the library.
_LEAD, _LEAD_END = 0xC2, 0xC9
_CONTRACTION = re.compile(rb"'(?:s|t|re|ve|m|ll|d)")
#: Pieces kept between chunks; only a cache.
CACHED_PIECES = 300_000


def _kind(char: str) -> int:
    if char in "\t\n\x0b\x0c\r \x85\xa0":
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(char)[0], OTHER)


_ONE = np.array([_kind(chr(i)) if i < 128 else 0 for i in range(256)], np.uint8)
_TWO = np.array([_kind(chr(i)) for i in range((_LEAD_END - 0xC0) << 6)], np.uint8)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 bytes stand for themselves, the rest are counted up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """``vocabulary``: the content of a tokenizers JSON file of a byte-level BPE."""

    def __init__(self, vocabulary: bytes):
        self.library = Tokenizer.from_str(vocabulary.decode("utf-8"))
        told = json.loads(vocabulary)
        special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.special = [x.encode() for x in special]
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in piece): i for piece, i in told["model"]["vocab"].items() if piece not in special}
        self.core = tiktoken.Encoding("vocabulary", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[bytes, bytes] = {}

    def encode_text(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of 4 bytes; as lists of numbers they would take many times the memory."""
        cache, one = self.cache, self.core._encode_single_piece
        if len(cache) > CACHED_PIECES:
            cache.clear()
        out = []
        for piece in pieces:
            ids = cache.get(piece)
            if ids is None:
                ids = cache[piece] = array("I", one(piece)).tobytes()
            out.append(ids)
        return out

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's first id (n + 1 offsets)."""
        n, size = len(at) - 1, len(data)
        if not size:
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        kind = _ONE[data]
        odd = data >= _LEAD_END
        lead = np.flatnonzero((data >= _LEAD) & (data < _LEAD_END))
        lead = lead[lead + 1 < size]
        code = ((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        two = _TWO[code]
        kind[lead] = two
        kind[lead + 1] = two
        odd[lead[two == SPACE]] = True
        plain = np.ones(n, bool)
        plain[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = False
        whole = data.tobytes()
        if b"'" in whole:
            found = [m.start() for m in _CONTRACTION.finditer(whole)]
            plain[np.searchsorted(at, np.array(found, np.int64), "right") - 1] = False
        for token in self.special:
            where = whole.find(token)
            while where >= 0:
                plain[np.searchsorted(at, where, "right") - 1] = False
                where = whole.find(token, where + 1)

        first = np.zeros(size, bool)
        first[0] = True
        first[1:] = kind[1:] != kind[:-1]
        begins = at[:-1][at[:-1] < size]
        first[begins] = True
        runs = np.flatnonzero(first)
        ends = np.append(runs[1:], size)
        last_of_text = np.zeros(size + 1, bool)
        last_of_text[at[1:]] = True
        blank = (kind[runs] == SPACE) & ~last_of_text[ends]
        end = ends[blank]
        joins = data[end - 1] == 0x20  # a last space goes to the piece that follows
        first[end[joins]] = False
        first[end - 1] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], size)
        text_of = np.searchsorted(at, starts, "right") - 1
        keep = plain[text_of]
        starts, ends, text_of = starts[keep], ends[keep], text_of[keep]

        coded = slices(data, starts, ends).dictionary_encode()
        which = coded.indices.to_numpy()
        ids = self._encode_pieces(coded.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32) if ids else np.zeros(0, np.uint32)
        begin = np.cumsum(length) - length
        per = length[which] if len(which) else np.zeros(0, np.int64)
        stream = flat[spans_to_index(begin[which], per)] if len(which) else np.zeros(0, np.uint32)
        count = np.bincount(text_of, weights=per, minlength=n).astype(np.int64)
        slow = np.flatnonzero(~plain)
        if not len(slow):
            return stream, np.concatenate([[0], np.cumsum(count)])
        own = {int(i): self.encode_text(whole[at[i] : at[i + 1]].decode("utf-8")) for i in slow}
        from_at = np.concatenate([[0], np.cumsum(count)])
        parts, last = [], 0
        for i, x in own.items():
            parts += [stream[from_at[last] : from_at[i]], x]
            last = i
            count[i] = len(x)
        parts.append(stream[from_at[last] :])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(count)])
