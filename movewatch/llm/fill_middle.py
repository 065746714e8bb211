"""Fill-in-the-middle transformation of texts, a batch at a time in Arrow's own functions.

A text is cut at two places into prefix, middle and suffix, which are put together with marks in another order. The
places and the form come from a hash of the document's id, so a run again gives the same rows. Inside a batch
the texts become lists of units (code points); the lists are flattened beside the number of the text each unit is of,
a unit's place in its text gives its role, each role's units are filtered out and made into lists again, and
the lists are joined into the pieces.

No row is shuffled. Units take many times the room of their text, so a text longer than ``WINDOW`` goes
through in windows, and texts are taken together up to one window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewatch.llm.common import free_name, in_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts left as they are, and per cent of the others with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = 1
#: Code points that are units at once.
WINDOW = 1 << 18


def unit_lists(texts: pa.Array) -> pa.ListArray:
    """Each text as the list of its code points."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    used = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    starts = np.flatnonzero((used & 0xC0) != 0x80).astype(np.int32) + offsets[0]
    ends = pa.py_buffer(np.append(starts, offsets[-1]).astype(np.int32))
    units = pa.StringArray.from_buffers(len(starts), ends, data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets).astype(np.int32)), units)


def pieces(texts: pa.Array, first: pa.Array, second: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each text, cut after ``first`` and ``second`` units."""
    lists = unit_lists(texts)
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begins = lists.offsets.slice(0, len(texts)).cast(pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(units))), begins.take(parent))
    behind = [pc.greater_equal(ordinal, cut.cast(pa.int64()).take(parent)).cast(pa.int8()) for cut in (first, second)]
    role = pc.add(*behind)
    made = []
    for wanted in range(3):
        mine = pc.equal(role, pa.scalar(wanted, pa.int8()))
        counts = np.bincount(parent.filter(mine).to_numpy(zero_copy_only=False), minlength=len(texts))
        ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        made.append(pc.binary_join(pa.ListArray.from_arrays(ends, units.filter(mine)), ""))
    return made


def _windows(texts: pa.Array, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The texts in windows: the text each is of, its content, and the two cuts counted from its start."""
    count = np.maximum(1, -(-n // WINDOW))
    own = np.repeat(np.arange(len(n)), count)
    start = (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    if len(own) > len(n):
        content = texts.to_pylist()
        texts = pa.array([content[i][s : s + WINDOW] for i, s in zip(own.tolist(), start.tolist())], pa.string())
    return own, texts, *(np.clip(cut[own] - start, 0, WINDOW) for cut in (first, second))


def cut_up(texts: pa.Array, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """``pieces`` of texts of any length, ``n`` code points each."""
    own, content, a, b = _windows(texts, n, first, second)
    size = np.minimum(n[own], WINDOW)
    share = (np.cumsum(size) - size) // WINDOW  # what is taken together: at most two windows
    bounds = [*np.flatnonzero(np.diff(share, prepend=-1)).tolist(), len(own)]
    parts = [pieces(content.slice(i, j - i), pa.array(a[i:j]), pa.array(b[i:j])) for i, j in zip(bounds, bounds[1:])]
    ends = pa.array(np.searchsorted(own, np.arange(len(n) + 1)).astype(np.int32))
    return [pc.binary_join(pa.ListArray.from_arrays(ends, pa.concat_arrays([p[r] for p in parts])), "") for r in range(3)]


def rearranged(texts: pa.Array, form: pa.Array, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> pa.Array:
    """The output of each text in its form: plain, prefix first (psm) or suffix first (spm)."""
    moved = pc.not_equal(form, "plain")
    at = np.flatnonzero(moved.to_numpy(zero_copy_only=False))
    if not len(at):
        return texts
    prefix, middle, suffix = cut_up(texts.filter(moved), n[at], first[at], second[at])
    spm = pc.equal(form.filter(moved), "spm")
    lead, follow = pc.if_else(spm, SUFFIX, PREFIX), pc.if_else(spm, PREFIX, SUFFIX)
    made = pc.binary_join_element_wise(lead, pc.if_else(spm, suffix, prefix), follow, pc.if_else(spm, prefix, suffix), MIDDLE, middle, "")
    return pc.replace_with_mask(texts, moved, made)


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 drawn for an id: the first groups of eight hex digits of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", doc_id: str = "doc_id", seed: int = SEED
) -> DataFrame:
    """``keep`` with n, form, prefix_chars, middle_chars and output of every row.

    A text that is null counts as empty. Empty texts, those that hold one of the three marks, and ``PLAIN`` per cent
    of the others stay as they are: form ``plain``, no piece lengths. Of the rest ``SUFFIX_FIRST`` per cent get the form
    ``spm``, the others ``psm``. A null id is drawn for like an empty one; rows of one id are cut alike, by their own lengths.
    Columns of ``keep`` may not be called like the five new ones. An empty table gives an empty one.
    """
    h = draws(F.col(doc_id), seed)
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    form = F.when((whole == "") | marked | (h[2] % 100 >= 100 - PLAIN), "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    hidden, length, kind, one, two = (free_name(df, c) for c in ("_text", "_n", "_form", "_one", "_two"))
    rows = df.select(whole.alias(hidden), F.char_length(whole).cast("long").alias(length), form.alias(kind), h[0].alias(one), h[1].alias(two), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, form = batch.column(0), batch.column(2)
            n, x, y = (batch.column(i).to_numpy() for i in (1, 3, 4))
            first, second = np.minimum(x % (n + 1), y % (n + 1)), np.maximum(x % (n + 1), y % (n + 1))
            plain = pc.equal(form, "plain").to_numpy(zero_copy_only=False)
            lengths = [pa.array(size, mask=plain) for size in (first, second - first)]
            output = rearranged(texts, form, n, first, second)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[5:], batch.column(1), form, *lengths, output],
                [*batch.schema.names[5:], "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[5:])
    return rows.mapInArrow(in_slices(run), f"{fields}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output in a form was made of: the marks tell the pieces apart, as no text that is cut holds one."""
    cut = [F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE)]
    mark = F.lit(len(PREFIX))
    lead, follow = F.least(cut[0], cut[1]), F.greatest(cut[0], cut[1])
    one = F.substr(output, lead + mark, follow - lead - mark)
    two = F.substr(output, follow + mark, cut[2] - follow - mark)
    middle = F.substr(output, cut[2] + mark)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
