"""Suffix-array dedup with a logarithmic index family.

Passages arrive in batches. Each batch gets a suffix array: the suffixes that
hold at least the match length, in the order of their bytes. Merge scans against
the arrays of the levels that exist then find every suffix whose longest common
prefix with one of theirs reaches the match length; the batch becomes a level
itself, and levels of equal size class merge, so that a family never holds more
than a logarithmic number of arrays. As only matches of that length count, the
order and the common prefixes are decided on so many leading bytes; suffixes
that agree there share a place in the array.

Which passages can match, and the shard they belong to, come from anchors (see
repeats): a suffix array of every byte of a corpus would be many times its size.

``dedup`` answers one table, its families living in the shards' tasks.
``SuffixIndex`` keeps documents, runs and families in a shared folder, so that
later batches of documents are scanned against the levels of all earlier ones.

Defined results: a null or empty text has no bytes; matches never cross
documents; rows that repeat match each other; fewer bytes than the match length:
nothing is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats

LENGTH, GRAM = 400, 100
BATCH_SUFFIXES = 1 << 17
#: Pairs of suffixes whose bytes are compared at once.
COMPARED = 1 << 10
#: A shard's task starts a new family at the next anchor once it holds so many suffixes.
FAMILY_SUFFIXES = 1 << 19


class IndexFamily:
    """Suffix arrays in levels of doubling size over one text of passages; every suffix knows whether it was met again."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self._set_text(b"")
        self.met = np.zeros(0, bool)
        #: Each level: places in the order of their suffixes, and the suffixes' leading eight bytes.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        #: (anchor, ctx, start in the text, number of suffixes) of each passage.
        self.passages: list[tuple[int, int, int, int]] = []
        self.size = 0

    def _set_text(self, text: bytes) -> None:
        self.text, self.padded = text, np.frombuffer(text + bytes(max(8, self.length)), np.uint8)

    def _keys(self, places: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """The eight bytes at this depth of each suffix as a number that sorts like them; what lies beyond the length counts as zero."""
        left = self.length - depth
        bytes_ = np.lib.stride_tricks.sliding_window_view(self.padded, 8)[places + depth]
        key = bytes_.view(">u8").ravel().astype(np.uint64)
        cut = (8 * np.maximum(8 - left, 0)).astype(np.uint64) if isinstance(left, np.ndarray) else np.uint64(8 * max(8 - left, 0))
        return key >> cut << cut

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefix of each pair of suffixes, up to the length."""
        heads = np.lib.stride_tricks.sliding_window_view(self.padded, self.length)
        out = np.empty(len(a), np.int64)
        for lo in range(0, len(a), COMPARED):
            differ = heads[a[lo : lo + COMPARED]] != heads[b[lo : lo + COMPARED]]
            first = differ.argmax(1)
            out[lo : lo + COMPARED] = np.where(differ[np.arange(len(first)), first], first, self.length)
        return out

    def add(self, passages: list[tuple[int, int, int, bytes]]) -> None:
        """A batch of passages (anchor, ctx, occurrences, bytes)."""
        at, starts, again = len(self.text), [], []
        for anchor, ctx, count, data in passages:
            n = len(data) - self.length + 1
            self.passages.append((anchor, ctx, at, n))
            starts.append(np.arange(at, at + n))
            if count > 1:
                again.append(starts[-1])
            at += len(data)
        self._set_text(b"".join([self.text, *(p[3] for p in passages)]))
        self.met = np.concatenate([self.met, np.zeros(at - len(self.met), bool)])
        for places in again:
            self.met[places] = True
        every = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.size += len(every)
        batch = level = self._suffix_array(every)
        while self.levels and len(self.levels[-1][0]).bit_length() <= len(level[0]).bit_length():
            older = self.levels.pop()
            at, same = self._merge_scan(older, level)
            level = tuple(np.insert(x, at[~same], y[~same]) for x, y in zip(older, level, strict=True))
        for older in self.levels:
            self._merge_scan(older, batch)
        self.levels.append(level)

    def _suffix_array(self, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in the order of their suffixes, one for each distinct head, and their leading bytes.

        Groups of suffixes that agree so far are parted by the eight bytes after
        the common prefix of all of them, until every group is parted or equal.
        """
        key = self._keys(every, 0)
        order = np.argsort(key, kind="stable")
        places, leading = every[order], key[order]
        new = np.ones(len(places), bool)
        new[1:] = leading[1:] != leading[:-1]
        settled = np.zeros(len(places), bool)
        while True:
            tied = ~new
            tied[:-1] |= ~new[1:]
            at = np.flatnonzero(tied & ~settled)
            if not len(at):
                break
            heads = np.flatnonzero(new[at])
            group = np.cumsum(new[at]) - 1
            depth = np.minimum.reduceat(self._common(places[at], places[at[heads]][group]), heads)
            equal = (depth >= self.length)[group]
            settled[at[equal]] = True
            self.met[places[at[equal]]] = True
            at, group = at[~equal], group[~equal]
            if len(at):
                key = self._keys(places[at], depth[group])
                order = np.lexsort((key, group))
                places[at], key = places[at[order]], key[order]
                new[at] = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        return places[new], leading[new]

    def _merge_scan(self, level: tuple[np.ndarray, np.ndarray], batch: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the batch's suffixes belongs in the level, and whether it shares the whole length with the one there: both are met again then."""
        (places, keys), (own, own_keys) = level, batch
        low, high = np.searchsorted(keys, own_keys, "left"), np.searchsorted(keys, own_keys, "right")
        same = np.zeros(len(own), bool)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            x, y = places[middle], own[open_]
            common = self._common(x, y)
            equal = common >= self.length
            same[open_[equal]] = True
            self.met[x[equal]] = True
            self.met[y[equal]] = True
            at = np.minimum(common, self.length - 1)
            after = self.padded[x + at] < self.padded[y + at]
            low[open_] = np.where(equal, middle, np.where(after, middle + 1, low[open_]))
            high[open_] = np.where(after & ~equal, high[open_], middle)
            open_ = open_[(low[open_] < high[open_]) & ~equal]
        return low, same

    def marks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(anchor, ctx, offsets) of the passages with suffixes that were met again."""
        for anchor, ctx, start, n in self.passages:
            own = np.flatnonzero(self.met[start : start + n])
            if len(own):
                yield anchor, ctx, own

    def state(self) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        sizes = np.array([len(x) for x, _ in self.levels], np.int64)
        places = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in self.levels)]).astype(np.int32)
        return self.text, np.packbits(self.met).tobytes(), np.array(self.passages, np.int64).tobytes(), sizes.tobytes(), places.tobytes()

    @classmethod
    def restored(cls, length: int, text: bytes, met: bytes, passages: bytes, sizes: bytes, levels: bytes) -> IndexFamily:
        own = cls(length)
        own._set_text(text)
        own.met = np.unpackbits(np.frombuffer(met, np.uint8), count=len(text)).astype(bool)
        own.passages = [tuple(p) for p in np.frombuffer(passages, np.int64).reshape(-1, 4).tolist()]
        own.size = sum(p[3] for p in own.passages)
        parts = np.split(np.frombuffer(levels, np.int32).astype(np.int64), np.cumsum(np.frombuffer(sizes, np.int64))[:-1]) if sizes else []
        own.levels = [(x, own._keys(x, 0)) for x in parts]
        return own


def _shard(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    yield from repeats.mark_batches(_compare(repeats.groups(batches), length))


def _fed(groups: Iterator[dict[str, list]], length: int, family: IndexFamily, limit: float) -> Iterator[IndexFamily]:
    """Families that the passages of sorted anchors were added to, batch by batch. Anchors never share windows, so a family may be closed at the end of any anchor."""
    batch, waiting = [], 0
    for g in groups:
        for ctx, cnt, payload in zip(g["ctx"], g["cnt"], g["payload"], strict=True):
            batch.append((g["anchor"][0], ctx, cnt, payload))
            waiting += len(payload) - length + 1
            if waiting >= BATCH_SUFFIXES:
                family.add(batch)
                batch, waiting = [], 0
        if family.size >= limit:
            family.add(batch)
            batch, waiting = [], 0
            yield family
            family = IndexFamily(length)
    family.add(batch)
    yield family


def _compare(groups: Iterator[dict[str, list]], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for family in _fed(groups, length, IndexFamily(length), FAMILY_SUFFIXES):
        yield from family.marks()


def _kept(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, spans_n, sha, kept = [], [], [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
            data = text.as_py() or b""
            own = data
            pairs: list[list[int]] = []
            if spans.is_valid:
                pairs = np.frombuffer(spans.as_py(), np.int32).reshape(-1, 2).tolist()
                edges = [0, *(x for p in pairs for x in p), len(data)]
                own = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            n.append(len(data))
            removed.append(len(data) - len(own))
            spans_n.append(len(pairs))
            sha.append(repeats.sha256(own))
            kept.append(own if texts else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_n, pa.int64()), pa.array(sha, pa.string()), batch.column("spans"), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_bytes"],
        )


#: A family's row: its state, after the number of its batch.
STATE = ("text", "met", "passages", "sizes", "levels")
DEALT = "shard int, kind int, anchor long, ctx long, id long, cnt long, payload binary, " + ", ".join(f"{c} binary" for c in STATE)


def _grow(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each shard, its stored family (kind 0) and the batch's passages (kind 1): the marks (kind 1) and the family as it is then (kind 0)."""

    def rows():
        for batch in batches:
            yield from batch.to_pylist()

    def out(**own) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: own.get(n) for n in schema.names}], schema)

    schema = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("anchor", pa.int64()), ("ctx", pa.int64()), ("marks", pa.binary()), *((c, pa.binary()) for c in STATE)])
    waiting = rows()
    row = next(waiting, None)
    while row:
        shard, family, batch, size = row["shard"], IndexFamily(length), [], 0
        while row and row["shard"] == shard:
            if row["kind"] == 0:
                family = IndexFamily.restored(length, *(row[c] for c in STATE))
            else:
                batch.append((row["anchor"], row["ctx"], row["cnt"], row["payload"]))
                size += len(row["payload"]) - length + 1
                if size >= BATCH_SUFFIXES:
                    family.add(batch)
                    batch, size = [], 0
            row = next(waiting, None)
        family.add(batch)
        for anchor, ctx, own in family.marks():
            yield out(shard=shard, kind=1, anchor=anchor, ctx=ctx, marks=repeats.packed(own))
        yield out(shard=shard, kind=0, **dict(zip(STATE, family.state(), strict=True)))


class SuffixIndex:
    """A lasting index in a shared folder; ``add`` commits a batch of documents, ``result`` answers all documents added.

    The folder holds, for each batch, its documents, the runs of their windows,
    and the families and marks of the shards that it touched. Passages enter a
    family when their anchor is met for the second time, older ones included; so
    unique text is never in an array. A batch counts once its last file is
    written, and adding a batch id again changes nothing. shards is fixed when
    the index is made: a task holds one shard's family, so it should follow the
    repeated text that is expected (some 16 MB of it each).
    """

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, gram: int = GRAM, shards: int = 64):
        self.spark, self.path, self.length, self.gram, self.shards = spark, path.rstrip("/"), length, gram, shards

    def _batches(self) -> list[str]:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        done = lambda p: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p}/grown/_SUCCESS"))
        return sorted(p for s in fs.listStatus(top) if done(p := s.getPath().toString())) if fs.exists(top) else []

    def _read(self, part: str) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{b}/{part}").withColumn("batch", F.lit(n)) for n, b in enumerate(self._batches())]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def add(self, batch_id: str, docs: DataFrame) -> bool:
        """Scan a batch of documents against the levels of all earlier ones. False if it was added before."""
        known = self._batches()
        names = [p.rsplit("/", 1)[1].split("-", 1)[1] for p in known]
        if batch_id.encode().hex() in names:
            return False
        to = f"{self.path}/{len(known):06d}-{batch_id.encode().hex()}"
        write = lambda df, part: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{to}/{part}")
        write(repeats.keyed(docs), "docs")
        own = self.spark.read.parquet(f"{to}/docs")
        write(repeats.runs_of(own, repeats.byte_symbols, self.length, self.gram, False), "runs")
        runs = self.spark.read.parquet(f"{to}/runs")
        counts = runs.groupBy("anchor").agg(F.count("*").alias("n"))
        old_runs, old_docs = self._read("runs"), self._read("docs")
        if old_runs is not None:
            before = old_runs.groupBy("anchor").agg(F.count("*").alias("old"))
            counts = common.cut(counts.join(before, "anchor", "left").na.fill(0, ["old"]).where("n + old > 1"), "anchors")
            # runs whose anchor was alone until now enter with the batch
            late = old_runs.drop("batch").join(counts.where("old = 1").select("anchor"), "anchor")
            entering = runs.join(counts.select("anchor"), "anchor").unionByName(late)
            own = own.unionByName(old_docs.drop("batch"))
        else:
            entering = runs.join(common.cut(counts.where("n > 1").select("anchor"), "anchors"), "anchor")
        passages = common.cut(repeats.held_contexts(entering).select("anchor", "ctx", "cnt", "held.id", "held.row", "held.s", "held.n"), "open")
        dealt = repeats.payloads(own, passages, passages.count(), repeats.byte_symbols, self.length).dropDuplicates(["anchor", "ctx"])
        dealt = dealt.select(F.pmod(F.hash("anchor"), F.lit(self.shards)).alias("shard"), F.lit(1).alias("kind"), "anchor", "ctx", "id", "cnt", "payload", *[F.lit(None).cast("binary").alias(c) for c in STATE])
        families = self._families()
        if families is not None:
            touched = common.cut(dealt.select("shard").distinct(), "touched")
            stored = families.join(F.broadcast(touched), "shard")  # at most a row for each shard
            dealt = dealt.unionByName(stored.select("shard", F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("anchor", "ctx", "id", "cnt")], F.lit(None).cast("binary").alias("payload"), *STATE))
        placed = dealt.repartition(self.shards, "shard").sortWithinPartitions("shard", "kind", "anchor", "ctx")
        length = self.length
        write(placed.mapInArrow(lambda it: _grow(it, length), "shard int, kind int, anchor long, ctx long, marks binary, " + ", ".join(f"{c} binary" for c in STATE)), "grown")
        return True

    def _newest(self, kind: int) -> DataFrame | None:
        """Rows of that kind from the last batch that touched their shard."""
        every = self._read("grown")
        if every is None:
            return None
        last = every.where("kind = 0").groupBy("shard").agg(F.max("batch").alias("batch"))
        return every.where(F.col("kind") == kind).join(F.broadcast(last), ["shard", "batch"])

    def _families(self) -> DataFrame | None:
        return self._newest(0)

    def result(self, texts: bool = False) -> DataFrame:
        """What ``dedup`` returns, for all documents of all batches."""
        docs, runs = self._read("docs"), self._read("runs")
        marks = self._newest(1).groupBy("anchor", "ctx").agg(F.collect_list("marks").alias("each"))
        # a passage that entered in several batches has marks for each time
        marks = marks.mapInArrow(_united, repeats.MARKS)
        found = common.cut(repeats.ranges(repeats.covered(runs.drop("batch"), marks, self.length)), "ranges")
        return _finished(docs.drop("batch"), found, texts)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for each in batch.column("each").to_pylist():
            pairs = np.concatenate([np.frombuffer(m, np.int32) for m in each]).reshape(-1, 2)
            out.append(repeats.packed(np.unique(np.concatenate([np.arange(a, b) for a, b in pairs.tolist()]))))
        yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("ctx"), pa.array(out, pa.binary())], names=["anchor", "ctx", "marks"])


def _finished(own: DataFrame, ranges: DataFrame, texts: bool) -> DataFrame:
    kind = dict(own.dtypes)["doc_id"]
    return repeats.with_ranges(own, ranges).mapInArrow(lambda it: _kept(it, texts), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary, kept_bytes binary")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False, hot: int = repeats.HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (int32 pairs of removed byte ranges) and, if asked for, kept_bytes."""
    own = repeats.keyed(docs)
    return _finished(own, repeats.repeated_ranges(own, repeats.byte_symbols, "uint8", length, gram, False, _shard, hot), texts)
