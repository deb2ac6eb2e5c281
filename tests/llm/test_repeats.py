import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from gridloom.llm import queries, suffix_automata, suffix_levels

from .conftest import make, messy


def words_expected(docs, length):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    for i, w in split:
        if i is not None:
            for s in range(len(w) - length + 1):
                k = tuple(w[s : s + length])
                first[k] = min(i, first.get(k, i))
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for s in range(len(w) - length + 1):
                if first[tuple(w[s : s + length])] < i:
                    gone.update(range(s, s + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def bytes_expected(docs, length):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(hashlib.md5(b[s : s + length]).digest() for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[hashlib.md5(b[s : s + length]).digest()] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1 << 16, 2])
def test_words(spark, hot):
    docs = messy(4)
    got = suffix_automata.dedup(make(spark, docs), hot=hot).drop("spans", "kept_text")
    assert sorted(map(tuple, got.collect()), key=str) == words_expected(docs, 50)
    assert got.where("n_removed > 0").count() > 10


@pytest.mark.parametrize("hot", [1 << 16, 2])
def test_bytes(spark, hot):
    docs = messy(5, 30, 200)
    got = suffix_levels.dedup(make(spark, docs), hot=hot).drop("spans", "kept_bytes")
    assert sorted(map(tuple, got.collect()), key=str) == bytes_expected(docs, 400)


def test_bytes_beyond_places(spark):
    """Two overlapping windows that repeat where an anchor's place no longer fits its bits (2^24), in a text where nothing else does; the seed leaves no other run at their anchor."""
    r = random.Random(2)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    before, period, after = letters(2000), letters(90), letters(2000)
    fill = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=(1 << 24) - 2150))
    text = fill + before + (period * 6)[:490] + after
    got = suffix_levels.dedup(make(spark, [(1, text), (2, "other")])).drop("spans", "kept_bytes").orderBy("doc_id").collect()
    kept = hashlib.sha256((fill + before + after).encode()).hexdigest()
    assert list(map(tuple, got)) == [(1, len(text), 490, 1, kept), (2, 5, 0, 0, hashlib.sha256(b"other").hexdigest())]


def met_expected(passages, length):
    heads = [(k, s, data[s : s + length]) for k, (_, _, _, data) in enumerate(passages) for s in range(len(data) - length + 1)]
    count = Counter(h for _, _, h in heads)
    out = defaultdict(list)
    for k, s, h in heads:
        if count[h] > 1 or passages[k][2] > 1:
            out[k].append(s)
    return dict(out)


def random_passages(seed, n):
    r = random.Random(seed)
    shared = [bytes(r.randrange(3) for _ in range(120)) for _ in range(5)]
    return [(7, k, 1 + (r.random() < 0.1), bytes(r.randrange(2) for _ in range(r.randrange(30))) + r.choice(shared) + b"\0" * r.randrange(60)) for k in range(n)]


def test_levels_merge(monkeypatch):
    monkeypatch.setattr(suffix_levels, "COMPARED", 37)
    every, family = random_passages(1, 160), suffix_levels.IndexFamily(40)
    for lo in range(0, 160, 10):
        family.add(every[lo : lo + 10])
        assert len(family.levels) <= 12
    assert {ctx: own.tolist() for _, ctx, own in family.marks()} == met_expected(every, 40)
    for level in family.levels:  # suffix arrays: distinct heads in order
        heads = [family.text[i : i + 40] for i in level[0].tolist()]
        assert heads == sorted(set(heads))
    again = suffix_levels.IndexFamily.restored(40, *family.state())
    more = [(p[0], 1000 + p[1], p[2], p[3]) for p in random_passages(2, 20)]
    again.add(more)
    want = met_expected([*every, *more], 40)
    assert {ctx if ctx < 1000 else ctx - 1000 + 160: own.tolist() for _, ctx, own in again.marks()} == want


def test_lasting_index(spark, tmp_path):
    """Batches added to an existing index: what all of them give at once."""
    docs = messy(5, 30, 200)
    index = suffix_levels.SuffixIndex(spark, str(tmp_path / "index"), shards=4)
    for k in range(4):
        assert index.add(f"b{k}", make(spark, docs[k::4]))
    assert not index.add("b1", make(spark, docs[:3]))
    later = suffix_levels.SuffixIndex(spark, str(tmp_path / "index"), shards=4)
    assert later.add("none", make(spark, docs).where("false"))
    got = later.result().drop("spans", "kept_bytes")
    assert sorted(map(tuple, got.collect()), key=str) == bytes_expected(docs, 400)


def test_empty_tables(spark):
    none = make(spark, messy()).where("false")
    assert suffix_automata.dedup(none).count() == 0 and suffix_levels.dedup(none).count() == 0


def test_whole_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op3_substring_dedup(spark, sf).collect()), key=str) == words_expected(docs, 50)
    assert sorted(map(tuple, queries.op8_suffix_levels(spark, sf).collect()), key=str) == bytes_expected(docs, 400)
