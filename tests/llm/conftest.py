import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, key string, rep long, spans string, items string, g string"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def make(spark, rows, schema=SCHEMA):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", None, None, 1, None, "k", None, "s", "i", "g") for i, t in rows], schema)


def messy(seed=1, n=60, words=400):
    """Random texts with shared passages, exact and near copies, nulls, empties, odd white space, a very long text and repeated rows."""
    r = random.Random(seed)
    vocabulary = [f"{r.choice(['w', 'é', 'Ab', '名'])}{i}" for i in range(300)]
    passages = [[r.choice(vocabulary) for _ in range(r.choice([30, 49, 50, 51, 90]))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(1, 5)):
            parts += [r.choice(vocabulary) for _ in range(r.randrange(words // 4))]
            if r.random() < 0.6:
                parts += r.choice(passages)
        rows.append((i * 3 + 7, r.choice([" ", "  ", "\n", " \t"]).join(parts)))
    base = rows[5][1].split()
    near = base[:]
    near[len(near) // 2] = "changed"
    rows += [(1000, rows[5][1]), (1001, " ".join(near)), (1002, rows[5][1]), (1002, rows[5][1]), (1003, None), (1004, ""), (1005, " \n "), (1006, "one"), (1007, "one"), (1008, "A b"), (1009, "a B")]
    rows += [(1010, " ".join(r.choice(vocabulary) for _ in range(30000)) + " " + " ".join(passages[4])), (1011, "same " * 300), (1012, "\x00\x0b same " * 120), (1013, "x y z \u0085 q"), (None, rows[6][1]), (None, None)]
    return rows
