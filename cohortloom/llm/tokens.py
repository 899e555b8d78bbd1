"""Batch encoding with a tokenizer of the ``tokenizers`` library.

The tokenizer drops white space and no piece of it crosses white space, so a
text's ids are the ids of its words in turn. In words of Latin letters, digits
and ASCII signs without an apostrophe, runs of letters, single digits and runs
of signs are pieces of their own, and the model of the library is asked for each
distinct piece once; other words go through the whole tokenizer once. Pieces are
told apart by length and a 64-bit hash of their bytes. Long texts and texts that
may hold the string of a special token are encoded whole.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

END_ID = 2
CACHED_PIECES = 1_200_000
BATCH_BYTES = 1 << 19
LONGEST_PIECE = 255
SLOTS = 1 << 21
FACTOR = 0x9E3779B97F4A7C15
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_classes() -> np.ndarray:
    classes = np.full(256, OTHER, np.uint8)
    classes[[0x20, *range(9, 14)]] = SPACE
    for b in range(0x21, 0x7F):
        classes[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else OTHER if b == 0x27 else SIGN
    return classes


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


CLASSES, BYTE_LETTERS = byte_classes(), byte_letters()


@lru_cache(maxsize=2)
def powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def piece_hashes(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes ``first:last`` of each piece."""
    n = 1 << max(20, int(len(text)).bit_length())
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(powers(n, FACTOR)[: len(text)] * (text + np.uint64(1)), out=sums[1:])
    found = (sums[last] - sums[first]) * powers(n, pow(FACTOR, -1, 1 << 64))[first]
    found ^= (last - first).astype(np.uint64) << np.uint64(56)
    found ^= found >> np.uint64(31)
    return found * np.uint64(FACTOR) | np.uint64(1)


class Pieces:
    """Ids of the pieces met so far, found by hash in an open table."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.keys, self.places = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.ids, self.starts = array("H"), array("q", [0])
        self.shift = np.uint64(64 - (SLOTS.bit_length() - 1))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and the positions of those unknown."""
        slots = (hashes >> self.shift).astype(np.int64)
        places = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        unknown = []
        while len(left):
            held = self.keys[slots]
            same = held == hashes[left]
            places[left[same]] = self.places[slots[same]]
            unknown.append(left[held == 0])
            on = ~same & (held != 0)
            left, slots = left[on], (slots[on] + 1) & (SLOTS - 1)
        return places, np.sort(np.concatenate(unknown)) if unknown else left

    def add(self, key: int, piece: bytes, odd: bool) -> None:
        self.ids.extend(self._encode(piece, odd))
        self.starts.append(len(self.ids))
        slot = int(key) >> int(self.shift)
        while self.keys[slot]:
            slot = (slot + 1) & (SLOTS - 1)
        self.keys[slot], self.places[slot] = key, len(self.starts) - 2

    def _encode(self, piece: bytes, odd: bool) -> list[int]:
        if odd:
            return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
        low = piece.lower() if piece.isascii() else piece.decode().lower().encode()
        shown = low.decode() if low.isascii() else low.decode("latin-1").translate(BYTE_LETTERS)
        return [t.id for t in self.model.tokenize(shown)]


class WordEncoder:
    """Ids of whole texts, equal to ``encode(text, add_special_tokens=False).ids``.

    ``literal`` reads the strings of special tokens in a text as ordinary text.
    The cache starts anew after ``cached`` pieces.
    """

    def __init__(self, path: str, literal: bool = False, cached: int = CACHED_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.cached = cached
        self.pieces = Pieces(self.tokenizer)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 16-bit integers; a null text is empty."""
        out: list[np.ndarray] = [np.empty(0, np.uint16)] * len(texts)
        group, size = [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if "<|" in text or len(text) > BATCH_BYTES:
                out[k] = self._whole(text)
                continue
            raw = text.encode()
            group.append((k, raw))
            size += len(raw) + 1
            if size >= BATCH_BYTES:
                self._encode_group(group, out)
                group, size = [], 0
        if group:
            self._encode_group(group, out)
        return out

    def _encode_group(self, group: list[tuple[int, bytes]], out: list[np.ndarray]) -> None:
        if len(self.pieces.starts) > self.cached:
            self.pieces = Pieces(self.tokenizer)
        joined = b" ".join([raw for _, raw in group]) + b" "
        text = np.frombuffer(joined, np.uint8)
        kinds = CLASSES[text]
        lead = np.flatnonzero((text >= 0xC3) & (text <= 0xC5))
        follow, after = text[lead], text[lead + 1]
        # Not letters with one lower case of their own: × ÷ İ
        plain = ~((follow == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (follow == 0xC4) & (after == 0xB0))
        kinds[lead[plain]] = kinds[lead[plain] + 1] = LETTER
        odd = np.flatnonzero(kinds == OTHER)
        if len(odd):
            gaps = np.flatnonzero(kinds == SPACE)
            word = np.unique(np.searchsorted(gaps, odd))
            lows = np.where(word > 0, gaps[word - 1] + 1, 0)
            for low, high in zip(lows, gaps[word]):
                kinds[low:high] = OTHER
        before = np.empty_like(kinds)
        before[0], before[1:] = SPACE, kinds[:-1]
        change = (kinds != before) | (kinds == DIGIT)
        first = np.flatnonzero(change & (kinds != SPACE))
        if not len(first):
            return
        breaks = np.append(np.flatnonzero(change), len(text))
        last = breaks[np.searchsorted(breaks, first, side="right")]
        keys = piece_hashes(text, first, last)
        places, unknown = self.pieces.find(keys)
        if len(unknown):
            _, once = np.unique(keys[unknown], return_index=True)
            for k in unknown[once].tolist():
                self.pieces.add(keys[k], joined[first[k] : last[k]], kinds[first[k]] == OTHER)
            places[unknown], _ = self.pieces.find(keys[unknown])
        starts = np.frombuffer(self.pieces.starts, np.int64)
        source = starts[places]
        lengths = starts[places + 1] - source
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(source - (ends - lengths), lengths)
        ids = np.frombuffer(self.pieces.ids, np.uint16)[at] if len(at) else np.empty(0, np.uint16)
        limits = np.cumsum([len(raw) + 1 for _, raw in group])
        counts = np.searchsorted(first, limits)
        cuts = np.concatenate([[0], ends])[counts]
        low = 0
        for (k, _), high in zip(group, cuts.tolist()):
            out[k] = ids[low:high]
            low = high


@lru_cache(maxsize=4)
def word_encoder(path: str, literal: bool = False) -> WordEncoder:
    """One encoder per worker process."""
    return WordEncoder(path, literal)


def encoded(
    texts: Sequence[str | None], path: str, end_id: int = END_ID, literal: bool = False
) -> Iterator[np.ndarray]:
    """The ids of each text with the end id after them."""
    for ids in word_encoder(path, literal).encode_batch(texts):
        yield np.append(ids, np.uint16(end_id))


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
