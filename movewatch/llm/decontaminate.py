"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a document with at most k edits shares m + 1 - q - k * q of its
q-grams with it, all on k + 1 neighbouring diagonals (place in the document less place in the item). Shared
q-grams are counted in bands of 2 * (k + 1) diagonals, each overlapping the next by half, so some band
holds them all; bands that reach the bound are verified by alignment within the band, which gives the edits.
Where very many do, as with a phrase that many items share, those go first around which too many of the item's 3-grams
are missing, each edit taking three at most.

The items go to the tasks in blocks of bounded size, one pass over the documents a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movewatch.llm.common import free_name, in_slices
from movewatch.llm.windows import PrefixHashes, batches

GRAM, EDIT_SHARE = 8, 0.1
#: Characters of items that are sent to the tasks at once, and characters of documents searched at once.
BLOCK_CHARS, BATCH_CHARS = 1 << 21, 1 << 19
_FILTER_BITS = 22
_U = np.uint64
#: Shared q-grams that are held at once, and items of an index: together they bound the memory, however common a phrase is.
HITS, PART_ITEMS = 1 << 21, 512
#: Short grams of sketches, their bits, places of a text a sketch's row is for, and bands from which sketches are worth it.
_SHORT, _SKETCH_BITS, _SPAN, _FEW = 3, 10, 64, 256
_WORDS = (1 << _SKETCH_BITS) // 64
_SHIFT = 1 << 33  # diagonals may be negative


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces; what documents and items are compared by."""
    return " ".join((text or "").replace("\0", " ").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    return PrefixHashes(codes.astype(_U) * _U(0x9FB21C651E98DF25) + _U(1)).every(q)


def edit_budget(length: int, share: float, q: int) -> int:
    """Edits allowed: a share of the length, less where the q-gram bound would not be above 0."""
    return max(0, min(int(share * length), (length - q) // q))


class Index:
    """The q-grams of some items: for each different one, the items and places it occurs at."""

    def __init__(self, codes: list[np.ndarray], which: list[int], q: int):
        grams = [_grams(codes[i], q) for i in which]
        item = np.repeat(np.array(which, np.int64), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        code = np.concatenate(grams) if grams else np.zeros(0, _U)
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, self.begin = np.unique(code[order], return_index=True)
        self.count = np.diff(np.append(self.begin, len(code)))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.gram >> _U(64 - _FILTER_BITS)] = True

    def slots(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``grams`` of those that are in the index, and their numbers there."""
        at = np.flatnonzero(self.filter[grams >> _U(64 - _FILTER_BITS)])
        slot = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        same = self.gram[slot] == grams[at]
        return at[same], slot[same]


class Sketch:
    """Which short grams stand near a place of a text, as bits of a few words: to drop what can't be within its edits."""

    def __init__(self, codes: np.ndarray, longest: int):
        own = np.zeros((len(codes) // _SPAN + 1, _WORDS), _U)
        bit = _short_bits(codes)
        np.bitwise_or.at(own, (np.arange(len(bit)) // _SPAN, bit >> 6), _U(1) << (bit & 63).astype(_U))
        self.levels = [own]
        while 2 ** len(self.levels) <= longest // _SPAN + 2:
            last, step = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(last | np.concatenate((last[step:], np.repeat(last[-1:], step, axis=0)))[: len(last)])

    def near(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The bits of the short grams that start in each range of places, and some around it."""
        top = len(self.levels[0]) - 1
        a, b = np.clip(low // _SPAN, 0, top), np.clip(high // _SPAN, 0, top)
        level = np.minimum(np.frexp(b - a + 1)[1] - 1, len(self.levels) - 1)
        out = np.empty((len(a), _WORDS), _U)
        for j in np.unique(level):
            at = level == j
            out[at] = self.levels[j][a[at]] | self.levels[j][np.maximum(a[at], b[at] - 2**j + 1)]
        return out


def _short_bits(codes: np.ndarray) -> np.ndarray:
    """The bit that stands for the short gram at each place."""
    return (_grams(codes, _SHORT) >> _U(64 - _SKETCH_BITS)).astype(np.int64) if len(codes) >= _SHORT else np.zeros(0, np.int64)


@dataclass
class Items:
    """A block of items with indexes of their q-grams, each of a bounded number of items; items too short for one apart."""

    ids: list
    texts: list[str]
    q: int
    share: float

    def __post_init__(self):
        self.codes = [_codes(t) for t in self.texts]
        self.short = [i for i, c in enumerate(self.codes) if 0 < len(c) < self.q]
        long = [i for i, c in enumerate(self.codes) if len(c) >= self.q]
        self.parts = [Index(self.codes, long[i : i + PART_ITEMS], self.q) for i in range(0, len(long), PART_ITEMS)]
        length = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([edit_budget(n, self.share, self.q) for n in length], np.int64)
        self.bound = length + 1 - self.q - self.budget * self.q
        #: What an occurrence takes up in a text at most.
        self.longest = int((length + 4 * self.budget + 4).max(initial=0)) + self.q
        self.bits = np.zeros((len(self.codes), _WORDS), _U)
        for i, c in enumerate(self.codes):
            bit = _short_bits(c)
            np.bitwise_or.at(self.bits[i], bit >> 6, _U(1) << (bit & 63).astype(_U))

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, diagonal) where the bands begin whose shared q-grams reach the bound, and whose short grams leave room for it.

        The text goes through in windows of at most ``HITS`` shared q-grams, or of two occurrences' length, each reaching one
        occurrence's length into the next: every occurrence lies in a window as a whole.
        """
        grams = _grams(codes, self.q)
        found, sketch = [np.zeros((2, 0), np.int64)], None
        for part in self.parts:
            at, slot = part.slots(grams)
            total = np.cumsum(part.count[slot])
            low = 0
            while low < len(at):
                before = total[low - 1] if low else 0
                high = max(int(np.searchsorted(total, before + HITS, "right")), int(np.searchsorted(at, at[low] + 2 * self.longest)))
                item, band = self._full(part, at[low:high], slot[low:high])
                diagonal = band * (self.budget[item] + 1) - _SHIFT
                if len(item) > _FEW:
                    sketch = sketch or Sketch(codes, self.longest)
                    near = self._near(sketch, item, diagonal)
                    item, diagonal = item[near], diagonal[near]
                found.append(np.stack((item, diagonal)))
                if high >= len(at):
                    break
                low = max(low + 1, int(np.searchsorted(at, at[high] - self.longest)))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))

    def _full(self, part: Index, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) that reach the bound in a window; band b holds diagonals from b * (k + 1) on."""
        count = part.count[slot]
        entry = np.repeat(part.begin[slot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, place, at = part.item[entry], part.place[entry], np.repeat(at, count)
        if not len(item):
            return item, item
        own = (at - place + _SHIFT) // (self.budget[item] + 1)
        key = np.concatenate((own, own - 1)) | np.concatenate((item, item)) << 36
        ordered = np.sort(key)
        new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        size = np.diff(np.append(new, len(key)))
        full = ordered[new][size >= self.bound[ordered[new] >> 36]]
        if len(full):
            # an item's q-gram counts once a band, however often the text repeats it
            slot = np.minimum(np.searchsorted(full, key), len(full) - 1)
            among = np.flatnonzero(full[slot] == key)
            pairs = np.unique(slot[among] << 32 | np.concatenate((place, place))[among])
            size = np.bincount(pairs >> 32, minlength=len(full))
            full = full[size >= self.bound[full >> 36]]
        return full >> 36, full & ((1 << 36) - 1)

    def _near(self, sketch: Sketch, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Whether an item's short grams that are missing around a band leave it within its edits: one edit takes ``_SHORT``."""
        out = np.empty(len(item), bool)
        length = self.bound + self.q - 1 + self.budget * self.q
        for i in range(0, len(item), 1 << 16):
            x, k = item[i : i + (1 << 16)], self.budget[item[i : i + (1 << 16)]]
            low = diagonal[i : i + (1 << 16)] - k
            bits = sketch.near(low, low + length[x] + 4 * k + 4)
            out[i : i + (1 << 16)] = np.bitwise_count(self.bits[x] & ~bits).sum(axis=1, dtype=np.int64) <= _SHORT * k
        return out


def align(item: np.ndarray, text: np.ndarray, diagonal: int, width: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best place of ``item`` in ``text`` on ``width`` diagonals from ``diagonal`` on.

    Fewest edits, then the earliest start. Cells hold the edits and, in their low bits, the start.
    """
    unit = 1 << 32
    padded = np.full(len(item) + width + 1, 0xFFFFFFFF, np.uint32)  # beyond the text nothing matches
    low, high = max(0, -diagonal), min(len(padded), len(text) - diagonal)
    if low < high:
        padded[low:high] = text[diagonal + low : diagonal + high]
    steps = np.arange(width, dtype=np.int64) * unit
    cells = np.arange(width, dtype=np.int64)
    for i, code in enumerate(item):
        replaced = cells + unit * (padded[i : i + width] != code)
        replaced[:-1] = np.minimum(replaced[:-1], cells[1:] + unit)
        cells = np.minimum.accumulate(replaced - steps) + steps
    best = int(cells.argmin())
    edits, start = divmod(int(cells[best]), unit)
    return edits, start + diagonal, best + diagonal + len(item)


def leaks(items: Items, text: str) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) in a normalised text: an item's best place, the earliest of equals."""
    found = {}
    codes = _codes(text)
    for i in items.short:
        at = text.find(items.texts[i])
        if at >= 0:
            found[i] = (0, at, at + len(items.codes[i]))
    if len(codes) >= items.q:
        which, diagonals = items.bands(codes)
        for i, diagonal in zip(which.tolist(), diagonals.tolist()):
            if found.get(i, (1,))[0] == 0:
                continue
            item, k = items.codes[i], int(items.budget[i])
            width = 2 * (k + 1) + 2 * k
            low, high = max(0, diagonal - k), min(len(codes), diagonal - k + width + len(item))
            exact = text.find(items.texts[i], low, high)
            result = (0, exact, exact + len(item)) if exact >= 0 else align(item, codes, diagonal - k, width)
            if result[0] <= k and (i not in found or result < found[i]):
                found[i] = (result[0], max(0, result[1]), min(len(codes), result[2]))
    return [(i, start, end, edits) for i, (edits, start, end) in sorted(found.items())]


def _search(items: Items, count: int):
    """Leaks of a stream of (text, other columns): the columns, repeated, and what was found."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [normal(t) for t in batch.column(0).to_pylist()]
            rows: list[int] = []
            made: list[tuple] = []
            for i, j in batches(texts, BATCH_CHARS):
                for at in _suspects(items, texts[i:j]):
                    for which, start, end, edits in leaks(items, texts[i + at]):
                        rows.append(i + at)
                        made.append((items.ids[which], start, end, edits))
            taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(1, count)]
            found = [pa.array(c, pa.int64()) for c in (zip(*made) if made else ((),) * 4)]
            yield pa.RecordBatch.from_arrays([*taken, *found], [*batch.schema.names[1:], "item_id", "start", "end", "edits"])
    return run


def _suspects(items: Items, texts: list[str]) -> list[int]:
    """The texts in which some band reaches an item's bound, found for all of them at once."""
    whole = "\0".join(texts)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    codes = _codes(whole)
    out = {n for n, t in enumerate(texts) if any(items.texts[i] in t for i in items.short)} if items.short else set()
    if len(codes) >= items.q:
        which, diagonals = items.bands(codes)
        # a band's diagonals may lie in more than one text
        width = 2 * (items.budget[which] + 1)
        size = np.array([len(c) for c in items.codes], np.int64)
        low = np.searchsorted(begins, diagonals, "right") - 1
        high = np.searchsorted(begins, diagonals + width + size[which], "right") - 1
        for a, b in zip(np.maximum(low, 0).tolist(), np.minimum(high, len(texts) - 1).tolist()):
            out.update(range(a, b + 1))
    return sorted(out)


def find(
    docs: DataFrame, benchmark: DataFrame, q: int = GRAM, share: float = EDIT_SHARE, text: str = "text",
    keep: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``keep``, item_id, start, end and edits: one row for each document and benchmark item that occurs in it.

    Texts are compared in lower case with single spaces; start and end (code points) are in that form, and
    are those of the item's best occurrence. An item occurs if at most ``share`` of its length are edits;
    fewer, where it is so short that no shared q-gram would be left, and none below q characters. Items without
    characters occur nowhere, null texts hold none; repeated items and rows are each reported. An empty table on either side gives
    an empty one.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    narrow = docs.select(F.col(text).alias(free_name(docs, "_text")), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])
    found = []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == block).collect()
        held = Items([r["id"] for r in own], [normal(r["text"]) for r in own], q, share)
        found.append(narrow.mapInArrow(in_slices(_search(held, len(keep) + 1)), f"{schema}, item_id long, start long, end long, edits long"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = GRAM, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item occurs."""
    items = benchmark.select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    place = docs.columns.index("text")
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        held = Items(list(range(len(own))), [normal(r["text"]) for r in own], q, share)
        docs = docs.mapInArrow(in_slices(_filter(held, place)), docs.schema)
    return docs


def _filter(items: Items, place: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [normal(t) for t in batch.column(place).to_pylist()]
            kept = np.ones(len(texts), bool)
            for i, j in batches(texts, BATCH_CHARS):
                for at in _suspects(items, texts[i:j]):
                    kept[i + at] = not leaks(items, texts[i + at])
            yield batch.filter(pa.array(kept))
    return run
