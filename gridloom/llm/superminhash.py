"""Near-duplicate documents by SuperMinHash.

1. Every text becomes its set of distinct word shingles; equal sets form a class.
2. A class gets a SuperMinHash signature: each shingle visits the slots in a
   random order of its own, the j-th visit offering j plus a random fraction,
   and a document stops when no later visit could lower any slot.
3. Slots are banded. Classes that share a band with others are candidates. Each
   is first checked against one smaller class (the band's least, that of most
   shared bands), on the full sets; confirmed links are merged by a distributed
   union-find that works on contracted edges.
4. Groups of candidates that then still hold several components are compared
   block against block, by signatures only: a class goes on with a pair of
   blocks if the other block has one of another component with enough slots
   alike. Those that go on are checked on the full sets, within the task that
   holds both blocks, which returns only links that join components.

A pair at the threshold shares no band with probability (1 - t**r)**b, 5e-8 for
t = 0.8, r = 4 and b = 32, and agrees in fewer slots than the floor of step 4
(78 of 128) with probability 8e-8, by the binomial distribution, which
SuperMinHash stays below; more similar pairs are missed more rarely. No bucket,
partner or candidate count is capped.

Defined results: a null text, or one without words, has an empty set and is
linked with nothing; a text with fewer words than a shingle has one shingle, the
whole sequence; rows that repeat a doc_id are one document, whatever their
texts: their sets' links are links of that doc_id, and each row is returned with
its own n_shingles and the one component; rows without doc_id are linked with
nothing and kept, with no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: A pair whose signatures agree in fewer slots than this share of the threshold lies over five standard deviations below it (see above).
SURELY_LESS = 0.77
ELEMENTS = 1 << 16
#: Ids up to this number are broadcast (16 MB) to fetch their documents; more are joined.
BROADCAST_IDS = 1 << 20
PAIR_BLOCK = 1024
#: Up to so many edges (1 MB), one task ends the union-find of components; more of them go through another round of joins.
LAST_EDGES = 1 << 16
#: Candidates that chains of shared bands connect are compared as one group up to this size, band by band beyond.
LARGE_GROUP = 1 << 14


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of all rows, and the index of each row's first one."""
    starts, ends, bounds = kernels.word_bounds(buf, offsets, kernels.SPACE_SEP)
    sums = kernels.prefix(kernels.word_hashes(buf, starts, ends, True))
    grams = kernels.windows(sums, k)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            sets.append(kernels.window(sums, np.array([a]), np.array([b])) if b > a else grams[:0])
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else grams[:0], at


def signatures(elements: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: a row of slots (visit * 2**32 + fraction) for each set."""
    n = len(at) - 1
    out = np.full((n, slots), np.iinfo(np.uint64).max, np.uint64)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + ELEMENTS, "right")) - 1)
        _signatures(elements[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], out[lo:hi])
        lo = hi
    return out


def _signatures(elements: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    slots = out.shape[1]
    row = kernels.rows_of(at)
    flat = out.reshape(-1)
    order = None
    for visit in range(slots):
        x = kernels.mix(elements + np.uint64((visit + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = visit + ((x >> np.uint64(32)) * np.uint64(slots - visit) >> np.uint64(32)).astype(np.int64)
        value = (x & np.uint64(0xFFFFFFFF)) | np.uint64(visit << 32)
        if visit == 0:
            slot = k
        else:
            each = np.arange(len(elements))
            slot = order[each, k].astype(np.int64)
            order[each, k] = order[:, visit]
        np.minimum.at(flat, row * slots + slot, value)
        open_rows = (out.max(1) >> np.uint64(32)) > np.uint64(visit)
        live = open_rows[row]
        if not live.any():
            return
        if visit == 0:
            elements, row, k = elements[live], row[live], k[live]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
            order[np.arange(len(elements)), k] = 0
        elif live.sum() < 0.7 * len(live):
            elements, row, order = elements[live], row[live], order[live]


def short(signature: np.ndarray) -> np.ndarray:
    """Sixteen bits of each slot."""
    return (signature & np.uint64(0xFFFF)).astype(np.uint16)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of 16-bit slots."""
    wide = signature.astype(np.uint64).reshape(len(signature), -1, rows)
    keys = np.zeros(wide.shape[:2], np.uint64)
    for r in range(rows):
        keys = kernels.mix(keys + wide[:, :, r] + np.uint64(r + 1))
    return kernels.mix(keys + np.arange(keys.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def set_sums(elements: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each set, whatever the order of its elements."""
    sums = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernels.mix(x))]) for x in (elements + np.uint64(1), elements ^ np.uint64(0x5DEECE66D5DEECE6)))
    low, high = (x[at[1:]] - x[at[:-1]] for x in sums)
    return low, high


def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = kernels.text_buffer(batch.column("text"))
        n, low, high, sig = [], [], [], []
        for a, b in kernels.blocks(offsets):
            elements, at = shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
            sizes = np.diff(at)
            n.append(sizes)
            for out, own in zip((low, high), set_sums(elements, at), strict=True):
                out.append(own)
            sig += [s.tobytes() if z else None for s, z in zip(short(signatures(elements, at)), sizes, strict=True)]
        join = lambda x: kernels.signed(np.concatenate(x).astype(np.uint64)) if x else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(join(n)), pa.array(join(low)), pa.array(join(high)), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_low", "set_high", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keys = band_keys(sig)
            yield pa.RecordBatch.from_arrays([pa.array(kernels.signed(keys.ravel())), pa.array(np.repeat(batch.column("rep").to_numpy(), keys.shape[1]))], names=["key", "rep"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = kernels.text_buffer(batch.column("text"))
        out, n, low, high = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for a, b in kernels.blocks(offsets):
            elements, at = shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
            out += [elements[at[i] : at[i + 1]].tobytes() for i in range(b - a)]
            sums = set_sums(elements, at)
            n.append(np.diff(at))
            low.append(sums[0])
            high.append(sums[1])
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(kernels.signed(np.concatenate(x))) for x in (low, high)), pa.array(np.concatenate(n), pa.int64()), pa.array(out, pa.binary())], names=["set_low", "set_high", "n_shingles", "shingles"]
        )


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= percent * (len(both) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sorted_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The runs of equal keys of a partition that is sorted by them."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.table(batch)
        new = np.zeros(len(t), bool)
        for key in keys:
            x = t.column(key).to_numpy()
            new[1:] |= x[1:] != x[:-1]
            new[0] |= not held or held[-1].column(key)[-1].as_py() != x[0]
        edges = [*np.flatnonzero(new).tolist(), len(t)]
        if edges[0]:
            held.append(t.slice(0, edges[0]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held:
                yield pa.concat_tables(held).combine_chunks()
            held = [t.slice(a, b - a)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _going_on(batches: Iterator[pa.RecordBatch], percent: int, floor: int) -> Iterator[pa.RecordBatch]:
    """The rows of a pair of blocks that have one of another component and of fitting size, with at least ``floor`` slots alike, in the other block (or in theirs, for a block with itself)."""
    for group in sorted_groups(batches, "g", "i", "j"):
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(group), -1)
        comp, block, size = (group.column(c).to_numpy() for c in ("comp", "block", "n_shingles"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        on = np.zeros(len(group), bool)
        for x in left.tolist():
            other = right[comp[right] != comp[x]]
            other = other[np.minimum(size[other], size[x]) * 100 >= np.maximum(size[other], size[x]) * percent]
            other = other[(sig[other] == sig[x]).sum(1) >= floor]
            if len(other):
                on[x] = True
                on[other] = True
        yield from group.filter(pa.array(on)).to_batches()


def _block_links(batches: Iterator[pa.RecordBatch], percent: int, floor: int) -> Iterator[pa.RecordBatch]:
    """Links that join components, found between two blocks of a group: pairs that agree in at least ``floor`` slots are checked on the full sets, unless links found before have joined them."""
    for group in sorted_groups(batches, "g", "i", "j"):
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(group), -1)
        rep, comp, block = (group.column(c).to_numpy() for c in ("rep", "comp", "block"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        _, comp = np.unique(comp, return_inverse=True)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out: list[tuple[int, int]] = []
        for x in left.tolist():
            other = right[(comp[right] != comp[x]) & ((rep[right] > rep[x]) | (i != j))]
            other = other[np.minimum(size[other], size[x]) * 100 >= np.maximum(size[other], size[x]) * percent]
            alike = (sig[other] == sig[x]).sum(1)
            other = other[np.argsort(-alike, kind="stable")][: int((alike >= floor).sum())]
            for y in other.tolist():
                if comp[x] == comp[y]:
                    continue
                at = np.minimum(np.searchsorted(sets[x], sets[y]), size[x] - 1)
                shared = int((sets[x][at] == sets[y]).sum())
                if 100 * shared >= percent * (size[x] + size[y] - shared):
                    out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
                    comp[comp == comp[y]] = comp[x]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])


def by_size(ids: DataFrame) -> DataFrame:
    """Ids as the side of a join: broadcast up to a checked number, else merged."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")


def _class(df: DataFrame) -> DataFrame:
    return df.withColumn("rep", F.xxhash64("set_low", "set_high", "n_shingles"))


def _fetch_sets(docs: DataFrame, wanted: DataFrame, k: int, several: bool) -> DataFrame:
    """(rep, shingles) of these classes (rep, holder), from the texts of their holders. several: a doc_id may stand in more than one row."""
    ids = wanted.select(F.col("holder").alias("wanted")).distinct()
    held = docs.join(by_size(ids), F.col("doc_id") == F.col("wanted"), "left_semi").select("text")
    sets = _class(held.mapInArrow(lambda it: _sets(it, k), "set_low long, set_high long, n_shingles long, shingles binary")).select("rep", "shingles")
    if several:  # those of the holders' other rows go, and one for each class stays
        sets = sets.join(by_size(wanted.select("rep")), "rep", "left_semi").dropDuplicates(["rep"])
    return sets


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets meet the threshold."""
    joined = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(lambda it: _verify(it, percent), "a long, b long")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (a, b) of a partition."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((find(root.setdefault(a, a)), find(root.setdefault(b, b))))
            root[high] = low
    yield pa.RecordBatch.from_arrays([pa.array([*root], pa.int64()), pa.array([find(x) for x in root], pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the least node of its component.

    Each round points every node at its least neighbour if that is smaller, jumps
    pointers until they are roots, and goes on with the edges between roots, whose
    number of nodes at least halves. All of it is joins and aggregations, but for
    the last LAST_EDGES edges, which one task unites; the driver only sees counts.
    """
    edges = common.cut(edges.where("a <> b").distinct(), "edges")
    labels: DataFrame | None = None
    while n := edges.count():
        last = n <= LAST_EDGES
        if last:
            parent = common.cut(edges.coalesce(1).mapInArrow(_united, "node long, root long"), "parent")
        else:
            both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a"))
            parent = common.cut(both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("root")), "parent")
        while not last:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = common.cut(parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "parent")
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent
        else:
            step = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = common.cut(labels.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
        if last:
            break
        x = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        y = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = common.cut(edges.join(x, "a").join(y, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept.

    docs: doc_id (integer) and text, besides any other columns. Documents are
    linked if the intersection of their sets of k-word shingles is at least
    percent % of the union.
    """
    own = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = common.cut(own.mapInArrow(lambda it: _describe(it, k), "doc_id long, n_shingles long, set_low long, set_high long, sig binary"), "described")
    described = _class(described)
    full = described.where("n_shingles > 0 and doc_id is not null")
    # rep stands for a class of equal sets; it is fetched from the texts of the doc_ids that hold it
    classes = common.cut(full.groupBy("rep").agg(F.min("doc_id").alias("holder"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "classes")
    # candidates: each class with the least class of each of its bands, one row for each such pair
    bands = classes.select("rep", "sig").mapInArrow(_bands, "key long, rep long")
    shared = common.cut(bands.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("most"), F.count("*").alias("n")).where("hub < most").select("key", "hub", "n"), "buckets")
    members = common.cut(bands.join(shared, "key"), "members")
    best = members.where("rep <> hub").groupBy("rep", "hub").count().groupBy("rep").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
    pairs = common.cut(best.select(F.col("hub").alias("a"), F.col("rep").alias("b")), "pairs")
    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "holder")
    # doc_ids in several rows: different sets of theirs join their classes
    repeated = common.cut(full.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most"), F.count("*").alias("n")).where("n > 1").select("doc_id", "a", "most"), "repeated")
    several = not repeated.isEmpty()
    sets = common.cut(_fetch_sets(own, wanted, k, several), "sets")
    links = _confirmed(pairs, sets, percent)
    if several:
        differ = repeated.where("a < most").select("doc_id", "a")
        links = links.union(full.join(by_size(differ), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")))
    first = components(links)
    # groups of candidates that still hold several components: what shared bands connect, or single bands where that is too large
    near = components(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    large = near.groupBy("root").count().where(F.col("count") > LARGE_GROUP).select(F.col("root").alias("group"))
    grouped = members.select("key", "rep").join(near.select(F.col("node").alias("rep"), F.col("root").alias("group")), "rep").join(large.withColumn("large", F.lit(True)), "group", "left")
    grouped = grouped.select(F.when(F.col("large"), F.col("key")).otherwise(F.col("group")).alias("g"), "rep").distinct()
    grouped = common.cut(grouped.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("g", "rep", F.coalesce("root", "rep").alias("comp")), "groups")
    mixed = common.cut(grouped.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x < y").select("g", "n"), "mixed")
    left = grouped.join(mixed, "g").withColumn("blocks", F.ceil(F.col("n") / PAIR_BLOCK).cast("int"))
    left = left.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).join(classes.select("rep", "sig", "n_shingles"), "rep")
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("g", "rep", "comp", "sig", "n_shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    floor = int(SURELY_LESS * percent / 100 * SLOTS)
    deal = lambda df: df.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    on = common.cut(deal(left).mapInArrow(lambda it: _going_on(it, percent, floor), left.schema), "going")
    links = common.cut(deal(on.join(sets, "rep")).mapInArrow(lambda it: _block_links(it, percent, floor), "a long, b long"), "links")
    to_comp = first.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    in_comp = links.join(to_comp, "a", "left").join(to_comp.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", "left")
    second = components(in_comp.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    # back to documents: the least doc_id of all classes of a component
    roots = classes.select("rep", "holder").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "holder", F.coalesce("root", "rep").alias("root"))
    roots = common.cut(roots.join(second.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("rep", "holder", F.coalesce("above", "root").alias("root")), "roots")
    least = common.cut(roots.groupBy("root").agg(F.min("holder").alias("component_id")), "least")
    named = roots.join(least, "root").select("rep", "component_id")
    out = described.join(named.withColumn("known", F.lit(True)), (described.rep == named.rep) & described.doc_id.isNotNull() & (described.n_shingles > 0), "left").select(described.doc_id, "n_shingles", "component_id")
    # an empty text of a doc_id that has others as well goes with them
    texts = common.cut(out, "found")
    empty = texts.where("doc_id is not null and component_id is null").select("doc_id").distinct()
    others = common.cut(texts.where("component_id is not null").join(empty, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("other")), "others")
    out = texts.join(by_size(others), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "other", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def brute_force(texts: list[tuple[int, str | None]], k: int, percent: int) -> list[tuple[int, int, int, bool]]:
    """The definition, all pairs; for tests."""
    import re

    sets = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [(i, len(a), find(i) if i is not None else None, i is None or find(i) == i) for i, a in sets]
