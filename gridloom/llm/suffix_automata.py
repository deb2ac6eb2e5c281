"""Substring dedup with suffix automata of reference shards.

Documents are read in the order of their ids against the automaton of what came
before: the matching statistic at a word is the length of the longest stretch
that ends there and occurs in an earlier document; where it reaches the window
length, the window is removed. The passages that can match at all, and the
shard they belong to, come from anchors (see repeats). So an automaton meets
only the passages that share an anchor with it, instead of being broadcast to
all documents: the repeated part of a corpus grows with it, and all automata
against all documents would be quadratic.

An anchor of more than HOT_CONTEXTS different passages has no automaton, which
no task could hold: its windows are spread over the cluster by fingerprint.

Defined results: a null or empty text has no words; a document without doc_id
neither loses words nor counts as earlier; rows that repeat a doc_id don't match
each other; fewer words than a window: nothing is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats

WINDOW, GRAM = 50, 25


class SuffixAutomaton:
    """The online construction over several sequences; symbols are any hashable values."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            to = nxt[last].get(symbol)
            if to is not None:
                if length[to] == length[last] + 1:
                    last = to
                else:
                    last = self._clone(last, to, symbol)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and symbol not in nxt[p]:
                nxt[p][symbol] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][symbol]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, symbol)
            last = cur

    def _clone(self, p: int, q: int, symbol) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = c
            p = link[p]
        return c

    def statistics(self, sequence: list) -> list[int]:
        """At each symbol, the length of the longest stretch ending there that occurs in the automaton."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for symbol in sequence:
            while state and symbol not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(symbol)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def _shard(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    yield from repeats.mark_batches(_compare(repeats.groups(batches), length))


def _compare(groups: Iterator[dict[str, list]], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for g in groups:
        automaton, waiting, before = SuffixAutomaton(), [], None
        for ctx, own, payload in zip(g["ctx"], g["id"], g["payload"], strict=True):
            sequence = np.frombuffer(payload, np.uint64).tolist()
            if own != before:  # passages of one document don't match each other
                for s in waiting:
                    automaton.add(s)
                waiting, before = [], own
            if len(automaton.next) > 1:
                marks = np.flatnonzero(np.array(automaton.statistics(sequence)) >= length) - (length - 1)
                if len(marks):
                    yield g["anchor"][0], ctx, marks
            waiting.append(sequence)


def _kept(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, sha, kept = [], [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
            words = (text.as_py() or b"").split()  # bytes: at \x20 and \x09-\x0D only
            own, at = words, 0
            if spans.is_valid:
                own = []
                for a, b in np.frombuffer(spans.as_py(), np.int32).reshape(-1, 2).tolist():
                    own += words[at:a]
                    at = b
                own += words[at:]
            n.append(len(words))
            removed.append(len(words) - len(own))
            joined = b" ".join(own)
            sha.append(repeats.sha256(joined))
            kept.append(joined.decode() if texts else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), batch.column("spans"), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"],
        )


def dedup(docs: DataFrame, length: int = WINDOW, gram: int = GRAM, texts: bool = False, hot: int = repeats.HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (int32 pairs of removed word ranges) and, if asked for, kept_text."""
    own = repeats.keyed(docs)
    ranges = repeats.repeated_ranges(own, repeats.word_symbols, "uint64", length, gram, True, _shard, hot)
    kind = dict(docs.dtypes)["doc_id"]
    return repeats.with_ranges(own, ranges).mapInArrow(lambda it: _kept(it, texts), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, spans binary, kept_text string")


