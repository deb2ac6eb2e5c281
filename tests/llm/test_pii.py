import hashlib
import re

from pyspark.sql import functions as F

from gridloom.llm import pii, queries

from .conftest import make, messy


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    for n, (kind, pattern, ok) in enumerate(rules):
        out += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(out)


def expected(docs):
    out = []
    for i, t in docs:
        found = base(t)
        n = [sum(k == kind for _, _, k, _ in found) for kind in ("email", "ip", "card", "phone")]
        out.append((i, *n, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in found).encode()).hexdigest()))
    return sorted(out, key=str)


ODD = [
    "mail a.b@c.de and x@y and q@z.w.v. also a@b.c@d.e !@x.y %+-@a-.b", "1.2.3.4 256.1.1.1 1.2.3 1.2.3.4.5.6.7.8 001.02.3.255 99999999999.1.1.1 1.1.1.1.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 5500005555555559 x 4111  1111 1111 1111 1 2 3 4 4111111111111111", "12345678901234567890 0000 0000 0000 00 00000000000000",
    "+1 (555) 123-4567 +12345678901 + 1 23 +1-2 +1 (2) 3.4-5 6 7 8 9 0 1 2 3 4 5 6 7", "😀 é +49 30 1234567 ü a@b.cd 😀 10.0.0.1", "+1 555 123 4567\n+1 555 123 4567", "+123456789012+123456789012 ++1 234 567 8901",
    "a" * 20000 + "@", "1" * 20000, "1." * 8000, "+1" + " 1" * 8000, "a@" * 5000, "a.b-" * 5000, "- " * 4000 + "4111 1111 1111 1111 -4",
]


def test_base_spans(spark):
    docs = [*enumerate(ODD), *messy()]
    got = pii.digest(pii.find(make(spark, docs))).drop("spans")
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs)
    assert pii.digest(pii.find(make(spark, []))).count() == 0


def test_random_strings(spark):
    import random

    r = random.Random(11)
    docs = [(i, "".join(r.choice("a1239.@-+ ()5%") for _ in range(r.randrange(200)))) for i in range(600)]
    docs += [(i + 600, "".join(r.choice("1 -4+") for _ in range(r.randrange(80)))) for i in range(400)]
    got = pii.digest(pii.find(make(spark, docs))).drop("spans")
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs)


def test_bootstrap_discovers_identifiers(spark):
    rows = [(i, f"Please write: contact me at user{i}@mail.example soon") for i in range(15)]
    rows += [(20, "yes contact me at ID-448812 soon"), (21, "see chapter at 448812 or so"), (22, "number 1234567 alone")]
    rows += [(30 + i, f"{p} agent-99{i}7312") for i, p in enumerate(["contact me at"] * 3)] 
    found = {r.doc_id: r.spans for r in pii.digest(pii.find(make(spark, rows))).collect()}
    assert found[20] == "id:18:27" and found[21] == "" and found[22] == "" and found[30] == "id:14:27"
    assert found[0].startswith("email:")


def test_redaction(spark):
    docs = make(spark, [(1, "to a@b.cd or 10.0.0.1 now"), (2, None), (3, "+1 555 123 4567"), (4, "1@2.3.4.5 x"), (5, "plain"), (1, "to a@b.cd or 10.0.0.1 now")])
    got = pii.with_spans(docs).select("doc_id", pii.redact(F.col("text"), F.col("pii_spans")).alias("t")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "to [EMAIL] or [IP] now"), (1, "to [EMAIL] or [IP] now"), (2, None), (3, "[PHONE]"), (4, "[EMAIL] x"), (5, "plain")], key=str)


def test_joined_spans(spark, monkeypatch):
    docs = make(spark, [*messy(), *[(5000 + i, f"mail to u{i}@x.yz") for i in range(20)], (6000, "mail to acct-551123")])
    key = lambda: sorted(map(str, pii.with_spans(docs).select("doc_id", "pii_spans").collect()))
    want = key()
    monkeypatch.setattr(pii, "BROADCAST_ROWS", -1)
    assert key() == want and "acct-551123" in str(want)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op7_pii(spark, sf)
    assert sorted(map(tuple, got.drop("spans").collect()), key=str) == expected(docs)
    spans = {r.doc_id: r.spans for r in got.collect()}
    for i, t in docs:
        own = [f"{k}:{s}:{e}" for s, _, k, e in base(t)]
        assert [x for x in spans[i].split(",") if x and not x.startswith("id:")] == own


def test_candidates_without_adjacent_digits(spark):
    """A token's four digits count wherever they are, and whatever else the text holds."""
    rows = make(spark, [(1, "code A1B2C3D4"), (2, "code A1B2C3D4 and 12"), (3, "code A1B2C3D"), (4, "a1 b2 c3 d4")])
    found = {r.doc_id: [x.v for x in r.x] for r in pii._scanned(rows.select("doc_id", "text"), "doc_id").collect()}
    assert found == {1: ["A1B2C3D4"], 2: ["A1B2C3D4"], 3: [], 4: []}


def discovered(docs):
    """The bootstrap in plain Python: id spans of each document."""
    graph, places = {}, {}
    for i, t in docs:
        t = t or ""
        own = [(s, e, True) for s, _, _, e in base(t)]
        for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{6,}", t):
            if sum(c.isdigit() for c in m[0]) >= 4 and not any(s < m.end() and m.start() < e for s, e, k in own if k):
                own.append((m.start(), m.end(), False))
        for s, e, seed in own:
            p = re.search(r"(\S*\s*\S+)\s*$", t[max(0, s - 60) : s])
            if p:
                p, v = p[1].lower(), t[s:e]
                graph[p, v] = graph.get((p, v), False) or seed
                if not seed:
                    places.setdefault(v, []).append((i, s, e))
    seeds = {v for (_, v), x in graph.items() if x}
    good, reached = {}, {}
    while True:
        scores = {**reached, **{v: 1.0 for v in seeds}}
        for p in {p for p, _ in graph}:
            own = [scores[v] for q, v in graph if q == p and v in scores]
            if sum(x >= 0.7 for x in own) >= 3 and sum(own) / len(own) >= 0.7:
                good[p] = max(good.get(p, 0), sum(own) / len(own))
        more = {}
        for p, v in graph:
            if p in good and v not in seeds:
                more[v] = more.get(v, 1.0) * max(1 - good[p], 1e-9)
        again = {v: 1 - x for v, x in more.items()}
        if len(again) == len(reached):
            return sorted((i, f"id:{s}:{e}") for v, x in again.items() if x >= 0.7 and v not in seeds for i, s, e in places.get(v, []))
        reached = again


def test_discovery_recall(spark):
    """Identifiers after patterns that seeds share, and after patterns that only those reach: all are found, as by brute force, and tokens after other words aren't."""
    import random

    r = random.Random(3)
    word = lambda: r.choice("lorem ipsum dolor sit amet elit sed do".split())
    docs, planted = [], 0
    for i in range(300):
        kind = r.random()
        some = " ".join(word() for _ in range(r.randrange(3, 20)))
        code = f"K{r.randrange(10**5, 10**6)}-{r.randrange(100)}"
        shared = f"K{5 * 10**6 + r.randrange(5)}"
        if kind < 0.3:
            some += f" reach me at u{i}@mail.example today"
        elif kind < 0.5:
            some, planted = f"{some} reach me at {code} today", planted + 1
        elif kind < 0.6:
            some, planted = f"{some} reach me at {shared} today", planted + 1
        elif kind < 0.75:
            some, planted = f"{some} badge number is {shared} here", planted + 1
        elif kind < 0.85:
            some, planted = f"{some} badge number is {code} here", planted + 1
        else:
            some += f" {word()} chapter {r.randrange(10**6, 10**7)}"
        docs.append((i, some))
    rows = pii.digest(pii.find(make(spark, docs))).collect()
    got = sorted((x.doc_id, s) for x in rows for s in x.spans.split(",") if s.startswith("id:"))
    assert got == discovered(docs)
    assert len(got) == planted and planted > 100


def test_very_many_matches(spark):
    text = " ".join(f"u{i}@mail.example" for i in range(8000))
    row = pii.digest(pii.find(make(spark, [(1, text)]))).drop("spans").collect()
    assert [tuple(x) for x in row] == expected([(1, text)])
