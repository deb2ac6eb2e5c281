import pytest

from gridloom.llm import queries, superminhash

from .conftest import make, messy


def shape(rows):
    """Rows with an id, and what each component holds; rows without one stand alone."""
    return sorted(rows, key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_messy(spark, k):
    docs = messy(7, 40, 120)
    got = superminhash.near_duplicates(make(spark, docs), k=k)
    assert shape(map(tuple, got.collect())) == shape(superminhash.brute_force(docs, k, 80))


def test_repeated_ids(spark):
    """A doc_id in several rows is one document, whose links are those of all its texts; an empty text of it goes with them."""
    rows = [(3, "a b c d"), (5, "a b c d"), (5, "x y z w"), (7, "x y z w"), (7, "x y z w"), (8, "q r s t"), (8, ""), (9, None), (9, None), (10, "q r s t"), (None, "a b c d"), (None, "x y z w")]
    got = [tuple(r) for r in superminhash.near_duplicates(make(spark, rows), k=2).collect()]
    assert shape(got) == shape(superminhash.brute_force(rows, 2, 80))
    assert {(i, c) for i, _, c, _ in got} == {(3, 3), (5, 3), (7, 3), (8, 8), (9, 9), (10, 8), (None, None)}


def test_links_at_the_threshold(spark):
    """Copies whose similarity is 0.8 to 0.85, one pair each: all links are found (recall 1; 0.9 is asked for)."""
    import random

    r, rows = random.Random(9), []
    while len(rows) < 1200:
        n = r.randrange(60, 200)
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        other = words[:]
        for at in r.sample(range(1, n - 1), max(1, round(n * 0.1 / 2))):
            other[at] = f"x{r.randrange(10**6)}"
        a, b = ({*zip(w, w[1:])} for w in (words, other))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    got = superminhash.near_duplicates(make(spark, rows), k=2).where("not kept").count()
    assert got == len(rows) // 2


@pytest.mark.parametrize("last", [0, 40, 1 << 16])
def test_components(spark, monkeypatch, last):
    """Rounds of joins, one task, and both in turn."""
    import random

    monkeypatch.setattr(superminhash, "LAST_EDGES", last)
    r = random.Random(3)
    chain = [*range(200, 260)]
    r.shuffle(chain)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [*zip(chain, chain[1:])] + [(7, 7)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = superminhash.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(root.items())
    assert superminhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("last", [0, 1 << 16])
def test_threshold_chains_and_blocks(spark, monkeypatch, last):
    """Chains of links around 0.8, in groups larger than a block."""
    monkeypatch.setattr(superminhash, "PAIR_BLOCK", 8)
    monkeypatch.setattr(superminhash, "LAST_EDGES", last)
    import random

    r, rows = random.Random(5), []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(60)]
        for step in range(25):
            rows.append((len(rows), " ".join(words)))
            for _ in range(r.choice([1, 2, 3])):
                words[r.randrange(60)] = f"g{g}s{step}x{r.randrange(99)}"
    got = superminhash.near_duplicates(make(spark, rows), k=2)
    assert shape(map(tuple, got.collect())) == shape(superminhash.brute_force(rows, 2, 80))


def test_empty(spark):
    assert superminhash.near_duplicates(make(spark, []), k=2).count() == 0
    assert superminhash.near_duplicates(make(spark, [(1, None)]), k=2).collect() == [(1, 0, 1, True)]


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert shape(map(tuple, queries.op10_superminhash(spark, sf).collect())) == shape(superminhash.brute_force(docs, 2, 80))
