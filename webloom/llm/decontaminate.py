"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task takes its documents in shards of bounded size, turns words into ids of the benchmark's vocabulary and sorts the shard's suffixes: those whose first words can begin a benchmark window at all, which loses no match. Every benchmark window, the beginning of a suffix, is then binary-searched in the shard, all at once, which gives all places where it occurs; from there each match is carried on as far as both texts go, so that every document has its longest verbatim match, with its place and item. No shuffle: the benchmark is the query set, sent in blocks of bounded size, one pass of the rows through each.

Words are lower-cased runs of letters, digits and non-ASCII characters. A window is `window` consecutive words of an item, an item of fewer words is one window. Nulls have no words: such a document has no hits, such an item no windows. Repeated documents each get their row, repeated items with one id count once, ids that are null are left out of the item list. Other columns are ignored; empty tables give no rows, or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import PLAIN, Words, pack, slices
from webloom.session import ship

WINDOW = 10
BLOCK_BYTES = 32 << 20  #: benchmark text in a block; its hashes are what is broadcast
SHARD_BYTES = 8 << 20
PAIRS = 1 << 20  #: matches that are carried on at once


class Probe:
    """A block of benchmark items, ready to be searched for. flat holds the items' words as ids in the sorted vocabulary, from 1, with a 0 before each item and at the end. Items of equal words are held once, under all their ids. Windows are places in flat; equal windows are one row, searched for once."""

    def __init__(self, item_ids: list, texts: pa.Array, window: int = WINDOW):
        order = sorted(range(len(item_ids)), key=lambda k: (item_ids[k] is None, str(item_ids[k])))
        item_ids, texts = [item_ids[k] for k in order], texts.take(pa.array(order, pa.int64()))
        words = Words(*pack(texts), PLAIN)
        self.vocabulary = np.unique(words.hash)
        ids = (np.searchsorted(self.vocabulary, words.hash) + 1).astype(np.int32)
        known: dict[bytes, int] = {}
        starts, sizes, items, pieces = [], [], [], []
        self.item_ids: list[list] = []
        at = 1
        for k, item in enumerate(item_ids):
            piece = ids[words.first[k] : words.first[k + 1]]
            n, key = len(piece), piece.tobytes()
            if not n:
                continue
            if key in known:
                self.item_ids[known[key]].append(item)
                continue
            known[key] = len(self.item_ids)
            count = max(1, n - window + 1)
            starts.append(np.arange(at, at + count))
            sizes.append(np.full(count, min(n, window)))
            items.append(np.full(count, len(self.item_ids), np.int32))
            self.item_ids.append([item])
            pieces.append((at, piece))
            at += n + 1
        self.window = window
        self.flat = np.zeros(at + window, np.int32)
        for start, piece in pieces:
            self.flat[start : start + len(piece)] = piece
        begin, size, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes, items))
        self.least = int(size.min()) if len(size) else 0
        both = (self.flat[:-1] > 0) & (self.flat[1:] > 0)
        self.pairs = np.unique(self.flat[:-1][both] * np.int64(len(self.vocabulary) + 1) + self.flat[1:][both])
        # windows in the order of their words; the places of equal ones stand together
        sorted_ = np.lexsort([*(self._column(begin, size, j) for j in range(window - 1, -1, -1))]) if len(begin) else np.zeros(0, np.int64)
        self.places, self.items, size = begin[sorted_].astype(np.int32), item[sorted_], size[sorted_]
        new = np.ones(len(sorted_), bool)
        if len(sorted_):
            new[1:] = np.logical_or.reduce([np.diff(self._column(self.places, size, j)) != 0 for j in range(window)])
        self.first = np.append(np.flatnonzero(new), len(sorted_))  # where each row's places begin
        self.row_size = size[self.first[:-1]]

    def _column(self, begin: np.ndarray, size: np.ndarray, j: int) -> np.ndarray:
        return np.where(j < size, self.flat[begin + j], 0)

    def rows(self, which: np.ndarray) -> np.ndarray:
        """The ids of these rows, 0 behind a short item."""
        j = np.arange(self.window)
        return np.where(j < self.row_size[which][:, None], self.flat[self.places[self.first[which]][:, None] + j], 0)


def _in(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return at, (sorted_[at] == x) if len(sorted_) else np.zeros(len(x), bool)


class SuffixArray:
    """Suffixes of a shard's id sequence (0: a word that no item has, or a text's end), sorted by their first `window` ids."""

    def __init__(self, ids: np.ndarray, probe: Probe):
        w = probe.window
        self.ids = np.concatenate([ids, np.zeros(w, ids.dtype)])
        if probe.least >= 2 and len(ids) > 1:
            ok = (ids[:-1] > 0) & (ids[1:] > 0)
            pair = ids[:-1] * (len(probe.vocabulary) + 1) + ids[1:]
            k = np.flatnonzero(ok)
            ok[k] = _in(probe.pairs, pair[k])[1]
            run = np.concatenate([[0], np.cumsum(~ok)])  # pairs that break a match, before each place
            need = probe.least - 1
            last = len(ids) - probe.least + 1
            keep = np.flatnonzero(run[need : need + max(0, last)] == run[: max(0, last)])
        else:
            keep = np.flatnonzero(ids > 0)
        order = np.lexsort([self.ids[keep + j] for j in range(w - 1, -1, -1)]) if len(keep) else np.zeros(0, np.int64)
        self.suffixes = keep[order]

    def compare(self, at: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffixes at these ranks are below, begin with, or are above the rows' first size ids."""
        w = rows.shape[1]
        got = self.ids[self.suffixes[at][:, None] + np.arange(w)]
        differ = (got != rows) & (np.arange(w) < size[:, None])
        first = differ.argmax(axis=1)
        k = np.arange(len(at))
        return np.where(differ.any(axis=1), np.sign(got[k, first] - rows[k, first]), 0)

    def bound(self, probe: Probe, upper: bool) -> np.ndarray:
        """For each of the probe's rows the first suffix that is not below it, or (upper) that is above all that begin with it."""
        n = len(probe.row_size)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.suffixes))
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            c = self.compare(mid, probe.rows(live), probe.row_size[live])
            right = c <= 0 if upper else c < 0
            lo[live] = np.where(right, mid + 1, lo[live])
            hi[live] = np.where(right, hi[live], mid)
        return lo

    def longest(self, probe: Probe, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words, place and item of every match that can't begin earlier, carried on beyond its window as far as both go, in blocks of PAIRS pairs of a benchmark suffix and a suffix of the shard."""
        hit = np.flatnonzero(hi > lo)
        wide = (hi - lo)[hit]
        upto = np.concatenate([[0], np.cumsum(wide * np.diff(probe.first)[hit])])
        for start in range(0, int(upto[-1]), PAIRS):
            pair = np.arange(start, min(start + PAIRS, int(upto[-1])))
            row = np.searchsorted(upto, pair, "right") - 1
            nth, across = np.divmod(pair - upto[row], wide[row])
            own = probe.first[hit[row]] + nth
            b, p = probe.places[own].astype(np.int64), self.suffixes[lo[hit[row]] + across]
            before = probe.flat[b - 1]
            keep = (before == 0) | (p == 0) | (self.ids[p - 1] != before)
            b, p, own, size = b[keep], p[keep], own[keep], probe.row_size[hit[row]][keep].astype(np.int64)
            live = np.arange(len(b))
            while live.size:
                got = probe.flat[b[live] + size[live]]
                live = live[(got > 0) & (got == self.ids[p[live] + size[live]])]
                size[live] += 1
            yield size, p, probe.items[own]


def _search(probe: Probe, words: Words, n_docs: int) -> tuple[list[list[tuple[int, int]]], list[set], list]:
    """For each text the word spans of window occurrences, the items they come from, and the longest match: words, where, item."""
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    items: list[set] = [set() for _ in range(n_docs)]
    best: list = [None] * n_docs
    if not len(probe.row_size) or not len(words.hash):
        return spans, items, best
    at, known = _in(probe.vocabulary, words.hash)
    # a 0 between texts keeps matches inside one
    doc = np.repeat(np.arange(n_docs), np.diff(words.first))
    ids = np.zeros(len(words.hash) + n_docs, np.int64)
    ids[np.arange(len(words.hash)) + doc] = np.where(known, at + 1, 0)
    array = SuffixArray(ids, probe)
    if not len(array.suffixes):
        return spans, items, best
    lo, hi = array.bound(probe, False), array.bound(probe, True)
    shift = words.first[:-1] + np.arange(n_docs)
    for r in np.flatnonzero(hi > lo):
        places = array.suffixes[lo[r] : hi[r]]
        docs = np.searchsorted(shift, places, "right") - 1
        own = [x for k in set(probe.items[probe.first[r] : probe.first[r + 1]].tolist()) for x in probe.item_ids[k]]
        for p, d in zip((places - shift[docs]).tolist(), docs.tolist(), strict=True):
            spans[d].append((p, p + int(probe.row_size[r])))
            items[d].update(own)
    for size, place, item in array.longest(probe, lo, hi):
        docs = np.searchsorted(shift, place, "right") - 1
        at = place - shift[docs]
        order = np.lexsort([item, at, -size, docs])
        head = order[np.flatnonzero(np.diff(docs[order], prepend=-1))]
        for d, n, p, k in zip(docs[head].tolist(), size[head].tolist(), at[head].tolist(), item[head].tolist(), strict=True):
            best[d] = better(best[d], {"words": n, "first": p, "item": probe.item_ids[k][0]})
    return spans, items, best


def better(a: dict | None, b: dict | None) -> dict | None:
    """The longer match; of equals the first in the text, then that of the smallest item as a string, one without an id last."""
    return min((x for x in (a, b) if x), key=lambda x: (-x["words"], x["first"], x["item"] is None, str(x["item"])), default=None)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


_FOUND = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _pass(probe):
    """Adds a block's spans, items and longest match to those of the blocks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = probe.value
        for part in slices(batches, "text", SHARD_BYTES):
            words = Words(*pack(part.column(1)), PLAIN)
            spans, items, best = _search(own, words, part.num_rows)
            before, had, was = part.column(3), part.column(4), part.column(5)
            for k in range(part.num_rows):
                if before[k].is_valid and len(before[k].values):
                    spans[k] = merge(spans[k] + [(x["first"], x["last"]) for x in before[k].as_py()])
                    items[k] |= set(had[k].as_py())
                    best[k] = better(best[k], was[k].as_py())
                else:
                    spans[k] = merge(spans[k])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(words.first), pa.int64()), pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], _FOUND), pa.array([sorted(x, key=str) for x in items], had.type), pa.array(best, was.type)],
                names=["row", "text", "n_words", "spans", "items", "longest"],
            )

    return run


def _probes(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Probe]:
    """Blocks of the benchmark, each within the size bound; the item count of a block is bounded by its bytes."""
    rows = benchmark.where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-int(total) // block_bytes) or 1
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow().combine_chunks()
        yield Probe(block.column(0).to_pylist(), block.column(1).combine_chunks() if block.num_rows else pa.array([], pa.string()), window)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (the id column), text, n_words, spans (word ranges that benchmark windows cover), items (their ids), longest (the longest match that holds a window: words, the word it begins at, item; null without one)."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<first:long,last:long>>").alias("spans"), F.lit(None).cast(f"array<{kind}>").alias("items"), F.lit(None).cast(f"struct<words:long,first:long,item:{kind}>").alias("longest"))
    schema = out.schema
    for probe in _probes(items, window, block_bytes):
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(probe)), schema)
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, n, sha = [], [], []
        for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            names = sorted({str(x) for x in items if x is not None})
            hit.append(sum(x["last"] - x["first"] for x in spans))
            n.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1)), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array([x > 0 for x in hit]), *(batch.column(k) for k in (4, 5, 6))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_words", "longest_at", "longest_item"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and of the longest match its words (0 without one), the word it begins at, from 0, and its item."""
    found = contaminated_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window)
    longest = F.coalesce("longest.words", F.lit(0).cast("long")).alias("longest_words"), F.col("longest.first").alias("longest_at"), F.col("longest.item").cast("string").alias("longest_item")
    made = found.select("row", "n_words", "spans", "items", *longest)
    return made.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_at long, longest_item string")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs. One narrow pass: the whole row rides along."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("text").alias("__text"))
    found = contaminated_spans(whole, benchmark, window, "whole", "__text")
    return found.where(F.size("spans") == 0).select("row.*")
