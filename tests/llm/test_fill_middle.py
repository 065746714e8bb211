"""Fill-in-the-middle against plain slicing of strings."""

import hashlib

import pytest

from movewatch.llm import fill_middle
from pyspark.sql import functions as F


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the rule, with Python's own strings."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def compared(df):
    rows = df.select("doc_id", "text").collect()
    made = fill_middle.fill_in_middle(df, keep=("doc_id", "text"))
    made = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made), key=key)
    want = sorted(((r.doc_id, r.text, *plain(r.doc_id, r.text), r.text or "") for r in rows), key=key)
    assert got == want
    return made


def test_edge_documents(edge_docs):
    compared(edge_docs)


def test_marks_wide_characters_and_every_form(spark):
    texts = ["a<P>b", "<S", "x<M>", "<", ">", "<<S", "a<", "é", "日本語テキスト", "😀😀a😀", "\x00\x01", "\n\t ", "P>S>M>"]
    rows = [(i, texts[i % len(texts)]) for i in range(600)] + [(None, "null id"), (7, None), (7, "again"), (7, "again")]
    made = compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.form for r in made} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("window", [1, 3, 64])
def test_texts_longer_than_a_window(spark, monkeypatch, window):
    texts = ["añ日😀<" * 40, "", "short", "ü" * 64, "x" * 65, "y" * 128, "z" * 3]
    cut = [(0, 0), (0, 0), (2, 5), (0, 64), (64, 65), (63, 64), (3, 3)]
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(fill_middle, "WINDOW", window)
    n = np.array([len(t) for t in texts])
    a, b = np.array(cut).T
    array = pa.array(["skipped", *texts]).slice(1)
    pieces = fill_middle.cut_up(array, n, a, b)
    assert [list(x) for x in zip(*(p.to_pylist() for p in pieces))] == [[t[:i], t[i:j], t[j:]] for t, (i, j) in zip(texts, cut)]


def test_long_text_and_empty_table(spark, no_docs):
    rows = [(i, "é日x" * 400_000) for i in range(4)]
    compared(spark.createDataFrame(rows, "doc_id long, text string"))
    made = fill_middle.fill_in_middle(no_docs)
    assert made.count() == 0 and made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
