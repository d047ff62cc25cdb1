"""Small documents with every odd case, and brute-force helpers."""

import random

import pytest

SYLLABLES = "an on the er in re ti ed ou st le qu au ne ra vi mo ta si du".split()


def prose(rng, n):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return "".join(w + ("\n" if i % 11 == 10 else " ") for i, w in enumerate(words)).strip()


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): prose, copies, near copies, shared passages, nulls, blanks, repeats, a long one."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(24)]
    passage = prose(rng, 45)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(30 + i, base[i % 3]) for i in range(9)]  # exact copies
    rows += [(40 + i, base[5].replace(" ", "  ", 1 + i)) for i in range(3)]  # the same words
    rows += [(50 + i, prose(rng, 10 + i) + " " + passage + " " + prose(rng, 12)) for i in range(6)]
    rows += [(60, base[7] + " " + base[7])]  # repeats within one text
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "é ü ñ 漢字 😀 " * 3), (75, "x" * 5000 + " y")]
    rows += [(80, " ".join(base) + "\n" + prose(rng, 6000))]  # very long
    rows += [(0, base[0]), (0, base[0]), (5, base[6]), (None, base[8]), (None, None)]  # repeated ids and null ids
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same with further columns, two of which clash with results."""
    rows = [(i, t, "en", f"src{k % 3}", None if t is None else len(t), 7, "mine") for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, spans string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark, texts):
    ids = sorted({i for i, _ in texts if i is not None})
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in ids] + [(None, 1, 1), (1, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int")
