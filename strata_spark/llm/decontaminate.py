"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

For each item of the benchmark (words, A-Z lower-cased) the documents' windows of exactly as many words are searched. A
window's SimHash has ``BITS`` bits, each the sign of the sum of one bit of its shingles' hashes, every shingle weighing as
often as it occurs. The index cuts fingerprints into blocks and lists, for every value of a block, the items whose block
is within ``RADIUS // blocks`` bits of it; a fingerprint within ``RADIUS`` of an item agrees that well in at least one
block, so all of them are found. A candidate is then verified: sum of smaller by sum of larger shingle counts of window
and item, at least ``SIMILARITY``.

Windows are not tried where they can't pass: one of n shingles needs ``SIMILARITY * n`` shingles that the benchmark
has, and of windows with equal overlap it is enough to try those that start at such a shingle. This bound loses none.

Items are searched in groups of at most ``GROUP_BYTES`` of text, one pass over the documents each, so what is sent to
the tasks stays bounded however large the benchmark is.

Defined cases: items and texts that are null or without words match nothing; an item of fewer than five words is one
shingle of all its words; repeated items or rows are reported each; of overlapping windows of an item in one document
the most similar (then first) one is reported; columns other than the ids and texts are not used.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata_spark.llm.tasks import map_arrow
from strata_spark.llm.words import WIDTH, blocks, mix, shingle_hashes, utf8, word_hashes

BITS = 128
BLOCKS = 8
RADIUS = 40
SIMILARITY = 0.75
GROUP_BYTES = 8 << 20
_HALF = np.uint64(0x9E3779B97F4A7C15)


def _votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's 128-bit hash."""
    both = np.stack([shingles, mix(shingles ^ _HALF)], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def simhash(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the windows of ``length`` shingles, as ``BITS // 8`` bytes each (a tied bit is 0)."""
    sums = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(_votes(shingles), axis=0, out=sums[1:])
    return np.packbits(sums[starts + length] - sums[starts] > 0, axis=1, bitorder="little")


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller by sum of the larger counts."""
    both = sum(min(n, b[x]) for x, n in a.items())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


@dataclass
class Item:
    """A benchmark item: shingle width, shingle counts, fingerprint."""

    item_id: int
    width: int
    length: int
    counts: Counter
    print_: np.ndarray


class HammingIndex:
    """Items of one window size by blocks of their fingerprints; ``near`` finds all within the radius."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, n_blocks: int = BLOCKS) -> None:
        self.prints, self.radius, self.n_blocks = prints, radius, n_blocks
        values = prints.view(np.uint16).reshape(len(prints), n_blocks)
        every = np.arange(1 << 16, dtype=np.uint16)
        slack = radius // n_blocks
        # one bitmap of block values a block: those within the slack of any item
        self.close = np.zeros((n_blocks, 1 << 16), bool)
        for b in range(n_blocks):
            for v in np.unique(values[:, b]):
                self.close[b] |= np.bitwise_count(every ^ v) <= slack
        self.values, self.slack = values, slack

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of every pair within the radius."""
        values = prints.view(np.uint16).reshape(len(prints), self.n_blocks)
        hit = np.zeros(len(prints), bool)
        for b in range(self.n_blocks):
            hit |= self.close[b][values[:, b]]
        for w in np.flatnonzero(hit):
            # only items that agree in some block; then the whole distance
            apart = np.bitwise_count(self.values ^ values[w])
            for i in np.flatnonzero((apart <= self.slack).any(axis=1)):
                distance = int(apart[i].sum())
                if distance <= self.radius:
                    yield int(w), int(i), distance


class Benchmark:
    """A group of items, ready to be searched in texts."""

    def __init__(self, rows: list[tuple[int, str | None]], similarity: float = SIMILARITY, radius: int = RADIUS) -> None:
        self.similarity = similarity
        sizes: dict[tuple[int, int], list[Item]] = defaultdict(list)
        for item_id, text in rows:
            words, _ = word_hashes(*utf8(pa.array([text], pa.string())))
            if len(words):
                width = min(WIDTH, len(words))
                shingles = shingle_hashes(words, width)
                sizes[width, len(shingles)].append(Item(
                    item_id, width, len(shingles), Counter(shingles.tolist()), simhash(shingles, np.zeros(1, int), len(shingles))[0]))
        self.sizes = {k: (v, HammingIndex(np.stack([x.print_ for x in v]), radius)) for k, v in sizes.items()}
        self.known = {w: np.unique(np.array([s for k, (v, _) in self.sizes.items() if k[0] == w for x in v for s in x.counts], np.uint64))
                      for w in {k[0] for k in self.sizes}}

    def _in_text(self, width: int, shingles: np.ndarray, shared: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(item, first word, words, distance, similarity) for all verified windows of one text."""
        found = np.concatenate([[0], np.cumsum(shared)])
        at = np.flatnonzero(shared)
        for (w, length), (items, index) in self.sizes.items():
            if w != width:
                continue
            # a shorter text is its own only window; it needs as many shared shingles as any other
            size = min(length, len(shingles))
            # the last window of the text may start before a shared shingle, all others need not
            starts = np.minimum(at, len(shingles) - size)
            starts = np.unique(starts[found[starts + size] - found[starts] >= self.similarity * length - 1e-9])
            if not len(starts):
                continue
            lo, hi = int(starts[0]), int(starts[-1]) + size
            for window, i, distance in index.near(simhash(shingles[lo:hi], starts - lo, size)):
                first = int(starts[window])
                score = weighted_similarity(Counter(shingles[first: first + size].tolist()), items[i].counts)
                if score >= self.similarity:
                    yield items[i].item_id, first, size + width - 1, distance, score

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(row, item, first word, words, distance, similarity): the best window of each item in each text."""
        raw_all, offsets_all = utf8(texts)
        for lo, hi in blocks(offsets_all):
            words, first = word_hashes(raw_all[offsets_all[lo]: offsets_all[hi]], offsets_all[lo: hi + 1] - offsets_all[lo])
            for width, known in self.known.items():
                every = shingle_hashes(words, width)
                at = np.minimum(np.searchsorted(known, every), len(known) - 1)
                shared = known[at] == every
                rows = np.unique(np.searchsorted(first, np.flatnonzero(shared), "right") - 1)
                for r in rows:
                    a, b = int(first[r]), int(first[r + 1]) - width + 1
                    if b <= a:
                        continue
                    best: dict[int, tuple] = {}
                    for item, start, n, distance, score in self._in_text(width, every[a:b], shared[a:b]):
                        if item not in best or (-score, start) < (-best[item][4], best[item][1]):
                            best[item] = (item, start, n, distance, score)
                    for x in best.values():
                        yield lo + int(r), *x


def benchmark_groups(items: DataFrame, group_bytes: int = GROUP_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items in groups of about ``group_bytes`` of text, by a hash of the item."""
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text")
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n or 0
    n = max(1, math.ceil(size / group_bytes))
    for g in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g) if n > 1 else items
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


FOUND = "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, distance int, similarity double"


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
               group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row a document and item found in it: place, Hamming distance and similarity of the best window."""
    def searcher(group: list[tuple[int, str]]):
        shared: list[Benchmark] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not shared:
                shared.append(Benchmark(group, similarity, radius))
            for batch in batches:
                found = list(shared[0].search(batch.column(1)))
                ids = batch.column(0).to_pylist() if found else []
                columns = list(zip(*[(ids[row], *rest) for row, *rest in found])) or [()] * 6
                kinds = (*[pa.int64()] * 4, pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=[f.split()[0] for f in FOUND.split(", ")])

        return map_arrow(docs.select("doc_id", "text"), run, FOUND)

    out = None
    for group in benchmark_groups(items, group_bytes):
        part = searcher(group)
        out = part if out is None else out.unionAll(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
               group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` without the rows in which an item was found, all columns as they were."""
    at = docs.columns.index("text")

    def cleaner(frame: DataFrame, group: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Benchmark(group, similarity, radius).search
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in search(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        return map_arrow(frame, run, frame.schema)

    for group in benchmark_groups(items, group_bytes):
        docs = cleaner(docs, group)
    return docs


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the best window."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
