import random

import pytest

WORDS = "ash birch cedar elm fir hazel larch maple oak pine rowan sorrel spruce thyme walnut willow yew".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = "shard string, slot string, size string, target string, taken string, fp string, score string, _text string, _key string, _place string, _cell string, _words string"


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(words))


def edge_rows():
    shared, line = prose(900, 45), "all rights reserved by the owners of this page and nobody else in the world, so there"
    texts = [prose(i, 60) for i in range(8)]
    texts += [texts[0], texts[1].upper(), texts[2] + " tail", "head " + texts[2]]
    texts += [prose(20, 15) + "\n" + shared + "\t " + prose(21, 30), shared + " " + prose(22, 9), prose(23, 9) + " " + shared, shared]
    texts += [" ".join([line] * 4), line, "oak " * 120, "é" * 250 + "ü", "é" * 251]
    texts += [None, None, "", "   \n\t ", "x", "a b", prose(30, 4000), prose(30, 4000), "\x1c no\xa0break   space \x85 end"]
    rows = [(i + 1, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, prose(40, 30), None, None, None), (None, prose(40, 30), None, None, None), (4, prose(41, 25), "en", "Z", 1), (None, None, None, "é", None)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with nulls, empty and long texts, ties, copies, repeated rows, and columns with clashing names."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    rows = [(*r, *["kept"] * len(names)) for r in edge_rows()]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASHING}").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
