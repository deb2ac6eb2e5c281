"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (email, ip, card, phone) come from regular expressions and are the
seeds. The words before a seed are a lexical pattern. Patterns and the
identifier-like tokens after them form a bipartite graph that Spark scores in
rounds until no pattern is added: a pattern is as good as the mean score of
those of its distinct instances that have one, if enough of these are good; an
instance is as good as the chance that not all of its patterns are wrong. Tokens
have no score until a good pattern reaches them. Those that are no base entity
and end with a high score become spans of kind `id`.

A token is identifier-like if it has at least six characters of A-Za-z0-9_- and
four digits among them; a pattern is the two words before it, lower-cased, of
whose text the last CONTEXT characters count.

Texts are read once, and no text is shuffled: what goes on from there are rows
of positions and short tokens. The expressions are written so that no attempt
rescans a stretch (possessive quantifiers, attempts only at a stretch's start),
and their matches are those of the plain definitions.

Defined results: a null or empty text has no spans; positions are code points,
ends exclusive; spans of different kinds may overlap; rows with equal doc_id and
text are each answered alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the expression to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Tokens that may be identifiers: at least six of these characters, four digits among them.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=(?:[A-Za-z_-]*+[0-9]){4})[A-Za-z0-9_-]{6,}+"
CONTEXT = 60
MIN_INSTANCES, CONFIDENCE = 3, 0.7
#: Matches of a text are placed in runs of so many, and the runs by their lengths: the work on a text is not quadratic in its matches.
RUN = 64
#: Characters of the pieces that the words before a span are taken from.
PIECE = 4096


_NO_SPANS = "cast(array() as array<struct<s:int,e:int,k:int,v:string>>)"


def _let(value: Column, body) -> Column:
    """body(value), value being computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(runs: Column) -> Column:
    """Where each run of matches begins in the text."""
    sizes = F.transform(runs, lambda own: F.aggregate(own, F.lit(0), lambda n, x: n + x["g"] + x["n"]))
    return F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )


def _in_run(own: Column, at: Column, kind: str) -> Column:
    return F.aggregate(
        own,
        F.struct(at.alias("at"), F.expr(_NO_SPANS).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["n"]).alias("e"), F.lit(KINDS.index(kind)).alias("k"), x["m"].alias("v")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _matches(text: Column, kind: str, pattern: str, hint: str | None) -> Column:
    """Array of (start, end, kind, value) of all matches: cut at the matches, the pieces between them give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))

    def placed(every: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(every) / RUN).cast("int") - 1, F.lit(0))), lambda c: F.slice(every, c * RUN + 1, RUN))
        return F.flatten(_let(cut, lambda runs: F.zip_with(runs, _starts(runs), lambda own, at: _in_run(own, at, kind))))

    run = _let(both, placed)
    may = F.rlike(text, F.lit(pattern)) if hint is None else F.contains(text, F.lit(hint)) & F.rlike(text, F.lit(pattern))
    return F.when(may, run).otherwise(F.expr(_NO_SPANS))


def luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    each = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") < 5, d.cast("int") * 2).otherwise(d.cast("int") * 2 - 9))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(x: Column) -> Column:
    digits = F.length(F.regexp_replace(x["v"], "[^0-9]", ""))
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(x["k"] == 1, F.rlike(x["v"], F.lit(rf"^{octet}(?:\.{octet}){{3}}$")))
        .when(x["k"] == 2, digits.between(14, 19) & luhn(x["v"]))
        .when(x["k"] == 3, digits.between(10, 15))
        .otherwise(F.lit(True))
    )


def base_spans(text: Column) -> Column:
    """Sorted array of (s, e, k, v): the base entities of a text."""
    every = F.concat(*[_matches(text, k, p, HINTS[k]) for k, p in PATTERNS.items()])
    return F.array_sort(F.filter(every, _valid))


def rendered(spans: Column) -> Column:
    """kind:start:end by start and kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["k"], x["e"]))), lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))))


def contexts(text: Column, spans: Column) -> Column:
    """For each span the pattern before it: the last two words, lower-cased, within CONTEXT characters. Taken from pieces of the text, so that a span doesn't read the whole of it."""
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda i: F.substring(text, i * PIECE + 1, PIECE))

    def before(pieces: Column, at: Column) -> Column:
        last = F.floor(at / PIECE).cast("int")
        both = F.concat(F.when(last > 0, F.get(pieces, last - 1)).otherwise(F.lit("")), F.get(pieces, last))
        to = at - F.greatest(last - 1, F.lit(0)) * PIECE
        return F.substring(both, F.greatest(to + 1 - CONTEXT, F.lit(1)), F.least(to, F.lit(CONTEXT)))

    return _let(cut, lambda pieces: F.transform(spans, lambda x: F.struct(x["s"], x["e"], x["k"], x["v"], F.lower(F.regexp_extract(before(pieces, x["s"]), r"(\S*\s*\S+)\s*$", 1)).alias("p"))))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps; base spans are looked at in runs, sorted by place, of which most are passed over as a whole."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(base) / RUN).cast("int") - 1, F.lit(0))), lambda c: F.slice(base, c * RUN + 1, RUN))
    runs = F.transform(F.filter(cut, lambda own: F.size(own) > 0), lambda own: F.struct(own.alias("own"), F.get(own, F.lit(0))["s"].alias("low"), F.array_max(F.transform(own, lambda b: b["e"])).alias("high")))
    meets = lambda t: lambda own: (own["low"] < t["e"]) & (t["s"] < own["high"]) & F.exists(own["own"], lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))
    return _let(runs, lambda every: F.filter(tokens, lambda t: ~F.exists(every, meets(t))))


def bootstrap(edges: DataFrame, min_instances: int = MIN_INSTANCES, confidence: float = CONFIDENCE) -> DataFrame:
    """Unseen instances (v) with their scores, from edges (p, v, seed). Good patterns stay good, so the rounds end."""
    graph = common.cut(edges.groupBy("p", "v").agg(F.max("seed").alias("seed")), "pii-graph")
    seeds = common.cut(graph.where("seed = 1").select("v").distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    unseen = graph.join(seeds.select("v"), "v", "left_anti")
    scores, good, n = seeds, None, 0
    while True:
        rated = graph.join(scores, "v").groupBy("p").agg(F.avg("score").alias("c"), F.sum(F.when(F.col("score") >= confidence, 1).otherwise(0)).alias("good"))
        rated = rated.where((F.col("good") >= min_instances) & (F.col("c") >= confidence)).select("p", "c")
        good = common.cut(rated if good is None else good.unionByName(rated).groupBy("p").agg(F.max("c").alias("c")), "pii-patterns")
        before, n = n, good.count()
        reached = unseen.join(good, "p").groupBy("v").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))).alias("score"))
        reached = common.cut(reached, "pii-scores")
        if n == before:
            return reached.where(F.col("score") >= confidence)
        scores = seeds.unionByName(reached)


#: Documents with discovered spans up to this number are broadcast to their texts; more are joined.
BROADCAST_ROWS = 1 << 16


def _scanned(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns and row_key, base, x: base spans, and in x all base entities and candidates with the patterns before them."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(*carried, text.alias("pii_text"), F.xxhash64("doc_id", text).alias("row_key"))
    text = F.col("pii_text")
    own = own.withColumn("base", base_spans(text))
    # the expression is tried only where a text holds four digits at all
    tokens = F.when(F.rlike(text, F.lit("(?:[0-9][^0-9]*+){4}")), _matches(text, "id", CANDIDATE, None))
    own = own.withColumn("tokens", F.coalesce(tokens, F.expr(_NO_SPANS)))
    own = own.withColumn("tokens", F.when((F.size("base") > 0) & (F.size("tokens") > 0), _apart(F.col("tokens"), F.col("base"))).otherwise(F.col("tokens")))
    none = F.expr("cast(array() as array<struct<s:int,e:int,k:int,v:string,p:string>>)")
    some = F.size("base") + F.size("tokens") > 0
    return common.cut(own.select(*carried, "row_key", "base", F.when(some, contexts(text, F.concat("base", "tokens"))).otherwise(none).alias("x")), "pii")


def _discovered(scanned: DataFrame) -> DataFrame:
    """(row_key, more): the spans that the bootstrap adds."""
    rows = scanned.where(F.size("x") > 0).select("row_key", F.explode("x").alias("x")).select("row_key", "x.*").where(F.length("p") > 0)
    unseen = bootstrap(rows.select("p", "v", (F.col("k") < KINDS.index("id")).cast("int").alias("seed")))
    return rows.where(F.col("k") == KINDS.index("id")).join(unseen, "v", "left_semi").groupBy("row_key").agg(F.collect_set(F.struct("s", "e", "k", "v")).alias("more"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, base and all spans (arrays of s, e, k, v) for every document."""
    scanned = _scanned(common.only(docs, "doc_id", "text"), "doc_id")
    spans = F.concat("base", F.coalesce("more", F.expr(_NO_SPANS)))
    return scanned.join(_discovered(scanned), "row_key", "left").select("doc_id", "row_key", "base", F.array_sort(spans).alias("spans"))


def with_spans(docs: DataFrame) -> DataFrame:
    """The columns of docs, and pii_spans. Texts are scanned once and written with their base spans; what the bootstrap adds is joined to them."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], "doc_id", "text")
    scanned = _scanned(plain, *[f"c{i}" for i in range(len(names))])
    more = common.cut(_discovered(scanned).withColumnRenamed("row_key", "pii_row"), "pii-more")
    side = F.broadcast(more) if more.count() <= BROADCAST_ROWS else more.hint("merge")
    joined = scanned.drop("x").join(side, F.col("row_key") == F.col("pii_row"), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.expr(_NO_SPANS))))
    return joined.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], spans.alias("pii_spans"))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping ones, replaced by [KIND]."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    merged = F.aggregate(
        F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["e"], x["k"]))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"])).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, merged).otherwise(text)
