"""Hashes of all windows of a batch of texts, and anchors that equal windows share.

A window is a fixed number of consecutive tokens (bytes or words) of one text. Its anchor is the gram, a
shorter run of tokens, with the smallest hash in it. Equal windows have equal anchors in equal places, so
two windows can only be equal if their anchor grams are. Neighbouring windows mostly share an
anchor: some 2 anchors for every ``window - gram + 2`` tokens stand for all windows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

_U = np.uint64
_PLACE = _U((1 << 28) - 1)  # the low bits of a packed gram: where it is in its batch
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=_U)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Tokens that are hashed at once; a longer text is a batch of its own.
BATCH_TOKENS = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below ``count`` or more."""
    have = _powers.get(base)
    if have is None or len(have[0]) < count:
        size = 1 << max(16, count - 1).bit_length() if count > 1 << 16 else 1 << 16
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, _U)
            x[0] = 1
            pair.append(np.cumprod(x))
        _powers[base] = have = (pair[0], pair[1])
    return have


class PrefixHashes:
    """Polynomial prefix hashes of a token sequence: the hash of any run in a few operations."""

    def __init__(self, tokens: np.ndarray, base: int = BASES[0]):
        up, self._down = powers(base, len(tokens) + 1)
        self._sums = np.zeros(len(tokens) + 1, _U)
        np.cumsum(tokens * up[: len(tokens)], out=self._sums[1:])

    def raw(self, start, length) -> np.ndarray:
        return (self._sums[start + length] - self._sums[start]) * self._down[start]

    def of(self, start, length) -> np.ndarray:
        return mix(self.raw(start, length))

    def every(self, length: int) -> np.ndarray:
        """The hash of the run of ``length`` at every place."""
        n = len(self._sums) - length
        return mix((self._sums[length:] - self._sums[:n]) * self._down[:n])


class Tokens(NamedTuple):
    """Tokens of several texts in a row: their hashes, where each text begins (and the end), and their bytes."""

    codes: np.ndarray
    begins: np.ndarray
    byte_from: np.ndarray | None
    byte_to: np.ndarray | None
    raw: bytes


def byte_tokens(texts: list[bytes]) -> Tokens:
    raw = b"".join(texts)
    begins = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    return Tokens(_BYTES[np.frombuffer(raw, np.uint8)], begins, None, None, raw)


def word_tokens(texts: list[bytes]) -> Tokens:
    """Words are what stands between the six ASCII white-space characters."""
    raw = b" ".join(texts)
    data = np.frombuffer(raw, np.uint8)
    solid = np.concatenate(([False], ~_SPACE[data], [False])).view(np.int8)
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    codes = PrefixHashes(_BYTES[data], BASES[1]).of(start, end - start) if len(start) else np.zeros(0, _U)
    text_begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    return Tokens(codes, np.searchsorted(start, text_begins), start, end, raw)


@dataclass(frozen=True)
class Kind:
    """What tokens and windows are: ``window`` tokens, anchored by their smallest ``gram``."""

    words: bool
    window: int
    gram: int

    @property
    def reach(self) -> int:
        """Grams in a window."""
        return self.window - self.gram + 1

    def tokens(self, texts: list[bytes]) -> Tokens:
        return word_tokens(texts) if self.words else byte_tokens(texts)


def batches(texts: list[bytes], most: int = BATCH_TOKENS):
    """Ranges of ``texts`` of about ``most`` bytes."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def window_starts(begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start, and the text of each."""
    count = np.maximum(0, np.diff(begins) - window + 1)
    text = np.repeat(np.arange(len(count)), count)
    return np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + begins[text], text


class Anchors(NamedTuple):
    """Per anchor: its text, place, and first and last window start; places are in the batch."""

    text: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray  # hash of the gram


def anchors(kind: Kind, tokens: Tokens, hashes: PrefixHashes) -> Anchors:
    starts, text = window_starts(tokens.begins, kind.window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, none.astype(_U))
    grams = hashes.every(kind.gram)
    # ties in the high bits go to the first place, the same in every batch
    least = sliding_least((grams & ~_PLACE) | np.arange(len(grams), dtype=_U), kind.reach)
    at = (least[starts] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    at, last = at[new], starts[np.append(new[1:], len(starts)) - 1]
    return Anchors(text[new], at, starts[new], last, grams[at])


def span_codes(kind: Kind, hashes: PrefixHashes, found: Anchors) -> np.ndarray:
    """A hash of all tokens that an anchor's windows cover, and of where the anchor is among them."""
    length = found.last - found.first + kind.window
    shape = ((found.at - found.first) * 65537 + length).astype(_U)
    return mix(hashes.raw(found.first, length) + shape * _U(0xFF51AFD7ED558CCD))
