"""Suffix-array and fixed-block deduplication against plain Python."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from movewatch.llm import queries, repeats, substring_dedup, suffix_dedup
from movewatch.llm.suffixes import SuffixOrder
from movewatch.llm.windows import Kind, PrefixHashes, anchors, byte_tokens

DATA = Path("/root/testdata/sf0.001")
LAST = 1 << 63


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def plain_suffixes(rows, window):
    """(doc_id, n_bytes, n_removed, n_spans, hash) of each row."""
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i : i + window] for _, b in raw for i in range(len(b) - window + 1))
    out = []
    for doc, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        out.append((doc, len(b), sum(gone), spans, digest(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def plain_windows(rows, window):
    """(doc_id, n_words, n_removed, hash) of each row; all rows have different ids or equal texts."""
    words = [(LAST if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]
    first = {}
    for doc, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (LAST + 1, 0)), (doc, i))
    out = []
    for doc, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (doc, i):
                gone[i : i + window] = [True] * window
        out.append((None if doc == LAST else doc, len(w), sum(gone), digest(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("hot", [1 << 16, 1])
def test_suffix_dedup_equals_plain(edge_docs, hot):
    given_rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert rows(suffix_dedup.remove_repeats(edge_docs, 60, hot=hot), *BYTES) == sorted(plain_suffixes(given_rows, 60), key=repr)


@pytest.mark.parametrize("hot", [1 << 16, 1])
def test_substring_dedup_equals_plain(edge_docs, hot):
    distinct = edge_docs.filter("doc_id IS NULL OR doc_id <> 4 OR lang = 'en' AND source <> 'Z'")
    given_rows = [(r.doc_id, r.text) for r in distinct.collect()]
    assert rows(substring_dedup.remove_later(distinct, 20, hot=hot), *WORDS) == sorted(plain_windows(given_rows, 20), key=repr)


def test_documents_that_share_an_id_are_ordered_by_content(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, "more " + text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.remove_later(docs, 20).collect()) == [0, 30]


def test_nothing_is_removed_but_by_the_comparison(spark, monkeypatch):
    shared = " ".join(f"w{i}" for i in range(60))
    texts = [f"{shared} {i} tail" for i in range(6)] + [f"{'head ' * i}{shared}" for i in range(1, 6)] + ["one two " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (1 << 16, 1):
        assert sum(r.n_removed for r in suffix_dedup.remove_repeats(docs, 60, hot=hot).collect()) > 2000
        assert sum(r.n_removed for r in substring_dedup.remove_later(docs, 20, hot=hot).collect()) > 500
    monkeypatch.setattr(suffix_dedup, "_in_order", lambda found: np.zeros(len(found.starts), bool))
    monkeypatch.setattr(substring_dedup, "_by_blocks", lambda found: np.zeros(len(found.starts), bool))
    for hot in (1 << 16, 1):
        assert sum(r.n_removed for r in suffix_dedup.remove_repeats(docs, 60, hot=hot).collect()) == 0
        assert sum(r.n_removed for r in substring_dedup.remove_later(docs, 20, hot=hot).collect()) == 0


@pytest.mark.parametrize("words", [False, True])
def test_equal_hashes_of_different_windows_remove_nothing(monkeypatch, words):
    texts = [b"a b c d e f g h", b"a b c d e f g i", b"q b c d e f g h", b"a b c d e f g h"]
    kind = Kind(words, 4 if words else 8, 2)
    monkeypatch.setattr(PrefixHashes, "raw", lambda self, start, length: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(PrefixHashes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    n = len(texts)
    found = repeats.Segments(kind, np.zeros(n, np.int64), [np.arange(n)] * 3, np.zeros(n, np.int64), texts)
    gone = (substring_dedup._by_blocks if words else suffix_dedup._in_order)(found)
    tokens = [t.split() for t in texts] if words else texts
    windows = [tuple(tokens[i][p : p + kind.window]) for i, p in zip(found.segment, found.place)]
    assert all(windows.count(w) > 1 for w, g in zip(windows, gone) if g)


def test_a_passage_with_many_copies_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "COPIES", 4)
    shared = " ".join(f"w{i}" for i in range(30))
    rows_ = [(i, f"{'x' * (i % 7)} {i} {shared} {i * 7}") for i in range(60)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").repartition(5)
    assert rows(suffix_dedup.remove_repeats(docs, 60), *BYTES) == sorted(plain_suffixes(rows_, 60), key=repr)
    assert rows(substring_dedup.remove_later(docs, 20), *WORDS) == sorted(plain_windows(rows_, 20), key=repr)


def test_long_windows(spark):
    rows_ = [(i, "ab c" * 1200 + str(i) + "xyz" * 900) for i in range(3)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    assert rows(suffix_dedup.remove_repeats(docs, 5500), *BYTES) == sorted(plain_suffixes(rows_, 5500), key=repr)
    assert rows(suffix_dedup.remove_repeats(docs, 4700), *BYTES) == sorted(plain_suffixes(rows_, 4700), key=repr)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, 70_000)


def test_texts_on_demand(edge_docs):
    got = suffix_dedup.remove_repeats(edge_docs.filter("doc_id < 25"), 60, with_text=True).collect()
    assert all(digest(bytes(r.kept)) == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)
    got = substring_dedup.remove_later(edge_docs.filter("doc_id < 25"), 20, with_text=True).collect()
    assert all(digest(r.kept.encode()) == r.kept_sha256 for r in got)


def test_empty_tables(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert substring_dedup.remove_later(no_docs).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="given tables are not here")
def test_queries_equal_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = rows(queries.QUERIES["op1_suffix_array_dedup"](spark, str(DATA)), *BYTES)
    assert got == sorted(plain_suffixes(docs, 200), key=repr)
    got = rows(queries.QUERIES["op8_substring_dedup"](spark, str(DATA)), *WORDS)
    assert got == sorted(plain_windows(docs, 20), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=40).map(lambda b: bytes(c % 3 for c in b)), min_size=1, max_size=8), st.integers(3, 12))
def test_suffix_order_and_classes(texts, depth):
    tokens = byte_tokens([t + b"\0" * depth for t in texts])
    starts = np.concatenate([np.arange(b, b + len(t)) for t, b in zip(texts, tokens.begins)]).astype(np.int64)
    group = np.zeros(len(starts), np.int64)
    order = SuffixOrder(np.frombuffer(tokens.raw, np.uint8), PrefixHashes(tokens.codes), depth)
    suffix = [tokens.raw[s : s + depth] for s in starts]
    assert [suffix[i] for i in order.sort(starts, group)] == sorted(suffix)
    by_class = defaultdict(set)
    for c, s in zip(order.repeated(starts, group), suffix):
        by_class[c].add(s)
    assert all(len(v) == 1 for v in by_class.values()) and len(by_class) == len(set(suffix))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 101, 120).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 101, n).astype(np.uint8).tobytes() + passage + b"xyz" * n for n in (0, 7, 50)]
    kind = Kind(False, 40, 10)
    tokens = byte_tokens(texts)
    found = anchors(kind, tokens, PrefixHashes(tokens.codes))
    place = {}
    for a, first, last in zip(found.at, found.first, found.last):
        for w in range(first, last + 1):
            assert w <= a <= w + 30
            place.setdefault(tokens.raw[w : w + 40], set()).add(a - w)
    assert sum(len(t) - 39 for t in texts) == int((found.last - found.first + 1).sum())
    assert all(len(p) == 1 for p in place.values())
