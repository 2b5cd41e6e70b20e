"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item of m words, the windows of m words of every document are fingerprinted by a 64-bit SimHash of
their five-word shingles, weighted by how often they occur. A multi-index over radius + 1 blocks of the fingerprint
finds every item within the Hamming radius of a window (two fingerprints that differ in at most radius bits agree in a
whole block). With the default radius of 7 the blocks have 8 bits, so one in 32 of unrelated items is looked at, and
near-exact passages are found. Fingerprints of pairs at similarity 0.8 may be 24 bits apart, and blocks for that radius
exclude nothing; so the rest is found by an exact way: a window as similar as the threshold must hold one of the item's
rarest shingles, so many that a window without all of them falls short. Whatever is found is verified by the exact
weighted Jaccard similarity of all windows around it. Windows that share no shingle with any item have similarity 0, so
only windows around shared shingles are fingerprinted; this loses nothing.

The benchmark is read in blocks of bounded size, each shared with all tasks for one pass over the documents, so it may
be of any size and the documents are never shuffled.

Edge cases: null and empty texts, in documents or benchmark, have no windows; an empty benchmark finds nothing; an item
of fewer than five words is one shingle, its whole word sequence; a document shorter than an item is compared as a
whole; repeated items and repeated documents each give rows; of windows that tie the first is reported; rows with a null
id keep it; columns beside the id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Lookup, Words, bounded_batches, fmix64, words_of

SHINGLE = 5
_LANES = fmix64(np.arange(1, 65, dtype=np.uint64))
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 of each shingle for each of the 64 bits."""
    return np.where(shingles[:, None] & _BITS, np.int32(1), np.int32(-1))


def simhash_windows(shingles: np.ndarray, size: int) -> np.ndarray:
    """The fingerprints of all runs of size shingles."""
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(_votes(shingles), axis=0, out=sums[1:])
    return ((sums[size:] - sums[:-size]) > 0) @ _BITS


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


class Multiindex:
    """Fingerprints of equal window size, found by any of radius + 1 blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        self.prints, self.radius = prints, radius
        self.blocks = [(np.uint64(lo), np.uint64((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts[:-1], cuts[1:])]
        self.tables = []
        for shift, mask in self.blocks:
            values = (prints >> shift) & mask
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], order))

    def near(self, prints: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (index into prints, index into the own fingerprints) within the radius, some more than once, in groups of about most candidates."""
        for (shift, mask), (values, order) in zip(self.blocks, self.tables):
            wanted = (prints >> shift) & mask
            lo = np.searchsorted(values, wanted, "left")
            n = np.searchsorted(values, wanted, "right") - lo
            ends = np.cumsum(n)
            first = 0
            while first < len(n):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
                at = np.repeat(np.arange(first, last), n[first:last])
                within = np.arange(len(at)) - np.repeat(np.cumsum(n[first:last]) - n[first:last], n[first:last])
                own = order[lo[at] + within]
                close = np.bitwise_count(prints[at] ^ self.prints[own]) <= self.radius
                yield at[close], own[close]
                first = last


class Size:
    """The distinct bags of shingles of items of one length, a multi-index of them, and the items of each rare shingle."""

    def __init__(self, words: int, bags: list[np.ndarray], radius: int, least: float):
        self.words, self.size = words, len(bags[0])
        self.bags = [Counter(b.tolist()) for b in bags]
        self.keys = [np.unique(b) for b in bags]
        self.index = Multiindex(np.array([simhash_windows(b, self.size)[0] for b in bags], np.uint64), radius)
        self.own, times = np.unique(np.concatenate(self.keys), return_counts=True)
        # a window similar enough has least of the item's shingles or more, however short it is: it can't lack more than spare
        spare = int(self.size * (1 - least) + 1e-9)
        rare, of = [], []
        for i, keys in enumerate(self.keys):
            order = keys[np.argsort(times[np.searchsorted(self.own, keys)], kind="stable")]
            weight = np.cumsum([self.bags[i][x] for x in order.tolist()])
            cut = order[: int(np.searchsorted(weight, spare, "right")) + 1]
            rare.append(cut), of.append(np.full(len(cut), i))
        rare, of = np.concatenate(rare), np.concatenate(of)
        order = np.argsort(rare, kind="stable")
        self.rare, self.items = rare[order], of[order]

    def by_rare(self, g: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each item and where in the shingles g some of its rare ones are."""
        lo = np.searchsorted(self.rare, g[places], "left")
        n = np.searchsorted(self.rare, g[places], "right") - lo
        ends, first = np.cumsum(n), 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 20), "right")))
            at = np.repeat(np.arange(first, last), n[first:last])
            items = self.items[lo[at] + np.arange(len(at)) - np.repeat(np.cumsum(n[first:last]) - n[first:last], n[first:last])]
            order = np.argsort(items, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(items[order])) + 1):
                if len(part):
                    yield int(items[part[0]]), places[at[part]]
            first = last


class Items:
    """The benchmark items of a block by their length; items of equal bags are looked for once."""

    def __init__(self, ids: list, texts: list, radius: int, least: float):
        self.ids, self.least = ids, least
        of: dict[tuple[int, bytes], list[int]] = {}
        runs: dict[tuple[int, bytes], np.ndarray] = {}
        for w in words_of(pa.array(texts, pa.string()), ALNUM):
            for d, m in enumerate(w.counts.tolist()):
                if m:
                    g = _run(w, d, min(m, SHINGLE))
                    key = m, np.sort(g).tobytes()
                    of.setdefault(key, []).append(w.lo + d)
                    runs.setdefault(key, g)
        lengths: dict[int, list[tuple[int, bytes]]] = {}
        for key in runs:
            lengths.setdefault(key[0], []).append(key)
        self.sizes = {m: Size(m, [runs[x] for x in keys], radius, least) for m, keys in lengths.items()}
        self.same = {m: [of[x] for x in keys] for m, keys in lengths.items()}
        known: dict[int, list[np.ndarray]] = {}
        for m, size in self.sizes.items():
            known.setdefault(min(m, SHINGLE), []).append(size.own)
        self.known = {k: Lookup(np.concatenate(v)) for k, v in known.items()}

    def leaks(self, w: Words) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, item, first word, words, similarity) of the best windows, one for each run of overlapping ones."""
        for k, known in self.known.items():
            grams, at = w.grams(k)
            hits = at[known(grams)]
            docs = np.searchsorted(w.first, hits, "right") - 1
            cut = np.flatnonzero(np.diff(docs, prepend=-1))
            for d, places in zip(docs[cut].tolist(), np.split(hits - w.first[docs], cut[1:]) if len(cut) else []):
                g = grams[np.searchsorted(at, w.first[d]) : np.searchsorted(at, w.first[d + 1])]
                for m, size in self.sizes.items():
                    if min(m, SHINGLE) == k:
                        mine = places[np.isin(g[places], size.own)]
                        if len(mine):
                            for bag, s, n, value in self._document(g, size, mine):
                                for item in self.same[m][bag]:
                                    yield w.lo + d, item, s, min(m, n + k - 1), value

    def _document(self, g: np.ndarray, size: Size, hits: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(bag, first word, shingles, similarity) of a document's shingles g, around those that some item has."""
        n = min(size.size, len(g))  # a shorter document is one window
        wanted: dict[int, list[np.ndarray]] = {}
        starts = _covered(hits, n, len(g))
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for lo in range(0, len(run), 1 << 14):
                part = run[lo : lo + (1 << 14)]
                for at, bags in size.index.near(simhash_windows(g[part[0] : part[-1] + n], n)):
                    for x, bag in zip(at.tolist(), bags.tolist()):
                        wanted.setdefault(bag, []).append(np.array([part[0] + x]))
        for bag, places in size.by_rare(g, hits):
            wanted.setdefault(bag, []).append(_covered(places, n, len(g)))
        for bag, found in wanted.items():
            near = np.unique(np.concatenate(found))
            near = np.unique(np.concatenate([near, _covered(near + n - 1, n, len(g)), _covered(near, n, len(g))]))  # all windows that overlap one of these
            inside = np.concatenate([[0], np.cumsum(np.isin(g, size.keys[bag]))])
            good = near[self._may(inside[near + n] - inside[near], n, size.size)]
            scored = ((s, similarity(Counter(g[s : s + n].tolist()), size.bags[bag])) for s in good.tolist())
            best = [x for x in scored if x[1] >= self.least]
            while best:
                group = [x for x in best if x[0] < best[0][0] + n]
                best = best[len(group) :]
                s, value = max(group, key=lambda x: (x[1], -x[0]))
                yield bag, s, n, value

    def _may(self, both: np.ndarray, n: int, size: int) -> np.ndarray:
        """Which windows of n shingles, so many of them known to the item, may be similar enough to it."""
        return both >= (n + size - both) * self.least - 1e-9


def _covered(places: np.ndarray, n: int, length: int) -> np.ndarray:
    """The starts of windows of n shingles, inside length, that hold one of these places."""
    steps = np.zeros(length + 2, np.int64)
    np.add.at(steps, np.clip(places - n + 1, 0, length - n), 1)
    np.add.at(steps, np.clip(places, 0, length - n) + 1, -1)
    return np.flatnonzero(np.cumsum(steps[: length - n + 1]) > 0)


#: The items that this Python worker has built, by block.
_BUILT: dict[str, Items] = {}


def _built(shared, radius: int, least: float) -> Items:
    name, ids, texts = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(ids, texts, radius, least)
    return _BUILT[name]


def _run(w: Words, d: int, k: int) -> np.ndarray:
    """The shingles of k words of document d, in order."""
    grams, at = w.grams(k)
    return grams[(at >= w.first[d]) & (at < w.first[d + 1])]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 7, block_items: int = 20_000) -> DataFrame:
    """Passages of docs (doc_id, text) as similar as least to an item of benchmark (item_id, text).

    Returns doc_id, item_id, first_word, n_words, similarity: the best of each run of overlapping windows. block_items
    bounds the items that a pass over docs takes; a larger benchmark takes more passes.
    """
    passes = _passes(benchmark, block_items)
    return reduce(DataFrame.unionAll, (_one_pass(docs, benchmark, least, radius, passes, p) for p in range(passes)))


def _block(benchmark: DataFrame, passes: int, p: int):
    """The ids and texts of block p, shared with the tasks, and the type of the ids."""
    block = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).toArrow()
    ids = block.column("item_id")
    return benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ids.to_pylist(), block.column("text").to_pylist())), ids.type


def _one_pass(docs, benchmark, least, radius, passes, p) -> DataFrame:
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    shared, kind = _block(benchmark, passes, p)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _built(shared, radius, least)
        for batch in batches:
            for w in words_of(batch.column("text"), ALNUM):
                found = list(items.leaks(w))
                if found:
                    d, i, s, n, v = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(d)), pa.array([items.ids[x] for x in i], kind), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(v, pa.float64())],
                        ["doc_id", "item_id", "first_word", "n_words", "similarity"],
                    )

    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {id_type}, item_id {item_type}, first_word long, n_words long, similarity double")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 7, block_items: int = 20_000) -> DataFrame:
    """The rows of docs, with all their columns, that hold no passage of the benchmark; nothing is shuffled."""
    passes = _passes(benchmark, block_items)
    for p in range(passes):
        docs = _without(docs, *_block(benchmark, passes, p), least, radius)
    return docs


def _without(docs: DataFrame, shared, _kind, least: float, radius: int) -> DataFrame:
    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _built(shared, radius, least)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for w in words_of(batch.column("text"), ALNUM):
                keep[[d for d, *_ in items.leaks(w)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def _passes(benchmark: DataFrame, block_items: int) -> int:
    bounded_batches(benchmark.sparkSession)
    return -(-max(1, benchmark.count()) // block_items)
