"""Jaccard self-join of word n-gram sets with a prefix tree.

A document's set holds its distinct shingles of five words, as 64-bit hashes; equal sets are one node (known by a hash of
the whole set), so copies are never paired. Two nodes link when 100 times the overlap is at least 75 times the union.
The class of a document is the smallest ``doc_id`` it reaches over links.

1. Every set is ordered by hash. Linked sets share at least m of their first ``n - ceil(0.75 n) + m`` shingles, for any
   m; with m a tenth of the set, one pass counts for every document how many of its first shingles it shares with a set
   of fitting size. Documents that share too few link with nothing and are left aside, as those with one common passage.
   Inside a task, sets that share a shingle are found at once and only two of a size class go on, so a shingle that a
   third of all documents have makes few rows.
2. The sets of the documents found are written once. They are ordered anew: shingles that few of them have first (by
   hash), common ones last (by count). The order decides only about the work, not about the links.
3. Candidates: first, in rounds, each node with one node of a list (nodes of a component are not paired again), which
   joins groups of near copies without pairing all of them; then all pairs of different components that share a list and
   can still reach the overlap by size, position and bitmaps of the sets (an element whose bit the other set lacks is no
   common one). So no link between different components is lost.
4. Candidates are verified in prefix trees. A group of sets is ordered by one order and stored in a tree; the other set
   walks down it, counting the overlap once for all sets that share a path, and leaves a branch as soon as the elements
   that remain on either side can't reach the overlap any more. Groups have at most ``TREE_SETS`` sets.

Defined cases: a text with fewer than five words is one shingle of all of them; a text that is null or has no words has
no set and is its own class; a null ``doc_id`` has a null class and lends none; rows that share a ``doc_id`` are separate
sets; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata_spark.llm.components import connected_components
from strata_spark.llm.tasks import map_arrow
from strata_spark.llm.words import blocks, mix, shingles_by_row, utf8, word_hashes
from strata_spark.session import written

#: Links need 100 * overlap >= PERCENT * union.
PERCENT = 75
#: One in so many shingles of a set must be shared among its first ones.
LEAD = 10
#: Sets of one prefix tree.
TREE_SETS = 200
#: Sets that have a shingle before it counts as common, and the longest list of common ones. Both only order the sets.
COMMON = 16
COMMON_LIST = 200_000
#: Longs of a set's bitmap.
BITMAP_LONGS = 16
#: Rounds with one partner a node, before all pairs that are left.
STAR_ROUNDS = 3
#: A table of ids of at most so many rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def distinct_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of rows: first row, each row's distinct shingles in order, offset of each row."""
    raw, offsets = utf8(texts)
    for lo, hi in blocks(offsets):
        words, first = word_hashes(raw[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
        shingles, at = shingles_by_row(words, first)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            shingles[a:b].sort()
        row = np.repeat(np.arange(hi - lo), np.diff(at))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (shingles[1:] != shingles[:-1])
        yield lo, shingles[new], np.searchsorted(row[new], np.arange(hi - lo + 1))


def _nodes(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each whole set, whatever its order; its size is mixed in."""
    total = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + mix(np.diff(at).astype(np.uint64))).view(np.int64)


def _prefix(n: np.ndarray, m: np.ndarray | int = 1) -> np.ndarray:
    """How many of the first shingles of a set of n hold m of any linked set."""
    return np.minimum(n, n - -(-n * PERCENT // 100) + m)


def _least_shared(n: Column) -> Column:
    """Shingles that a set of n must share among its first ones: what its smallest partner asks for."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * PERCENT / 100) / LEAD))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, node = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, shingles, at in distinct_sets(batch.column(1)):
            n.append(np.diff(at))
            node.append(_nodes(shingles, at))
        n, node = np.concatenate(n), np.concatenate(node)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node, mask=n == 0)],
                                         names=["doc_id", "n_shingles", "node"])


def _first_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, n, doc_id, counted)`` of the first shingles; a null key: ``n`` first shingles shared inside the task."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, shingles, at in distinct_sets(batch.column(1)):
            n = np.diff(at)
            node, take = _nodes(shingles, at), _prefix(n, np.maximum(1, n // LEAD))
            row = np.repeat(np.arange(len(n)), take)
            if not len(row):
                continue
            key = shingles[at[row] + np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)]
            size_class = np.floor(np.log(n[row]) / np.log(100 / PERCENT)).astype(np.int64)
            order = np.lexsort((n[row], size_class, key))
            row, key, size_class = row[order], key[order], size_class[order]
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (size_class[1:] != size_class[:-1])]))
            ends = np.append(starts[1:], len(key))
            # two sets of one size class: sizes fit
            near = np.repeat(np.minimum.reduceat(node[row], starts) != np.maximum.reduceat(node[row], starts), ends - starts)
            shared = np.bincount(row[near], minlength=len(n))
            some = np.flatnonzero(shared)
            out = np.unique(np.concatenate([starts, ends - 1]))
            none = np.arange(len(out) + len(some)) >= len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key[out].view(np.int64), np.zeros(len(some), np.int64)]), mask=none),
                 pa.array(np.concatenate([n[row[out]], shared[some]])),
                 pa.array(np.concatenate([ids[lo + row[out]], ids[lo + some]]).astype(np.int64)),
                 pa.array(np.concatenate([near[out], np.ones(len(some), bool)]).astype(np.int32))], names=["key", "n", "doc_id", "counted"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, shared)``: shingles for which a document stands next to another of fitting size."""
    held = None
    for batch in batches:
        known = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
        key, n, doc, counted = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(4))
        docs, shared = [doc[~known]], [n[~known]]
        key, n, doc, counted = (x[known] for x in (key, n, doc, counted))
        if held is not None:
            key, n, doc, counted = (np.concatenate([[a], b]) for a, b in zip(held, (key, n, doc, counted)))
        if len(key):
            fits = (key[1:] == key[:-1]) & (doc[1:] != doc[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])
            hit = np.zeros(len(key), bool)
            hit[1:] |= fits
            hit[:-1] |= fits
            # the last row waits for the next batch; if it is counted now, it must not be again
            held = key[-1], n[-1], doc[-1], counted[-1] | hit[-1]
            docs.append(doc[hit & (counted == 0)])
            shared.append(np.ones(len(docs[-1]), np.int64))
        found, at = np.unique(np.concatenate(docs), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(shared), minlength=len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total)], names=["doc_id", "shared"])


def _small(df: DataFrame) -> DataFrame:
    """A written table of ids: broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, n, shingles)`` of one document of each node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, shingles, at in distinct_sets(batch.column(1)):
                node = _nodes(shingles, at)
                same = np.flatnonzero(node == expected[lo: lo + len(node)])  # else another row of that doc_id
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[same]), pa.array(np.diff(at)[same]),
                     pa.array([shingles[at[r]: at[r + 1]].tobytes() for r in same], pa.binary())], names=["node", "n", "shingles"])

    return map_arrow(docs.join(_small(wanted), "doc_id").select("node", "text"), run, "node bigint, n bigint, shingles binary")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column(0).to_pylist()
        key, count = np.unique(np.frombuffer(b"".join(blobs), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], names=["key", "sets"])


def _common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many sets and their place, rising by the number of sets: a hint for the order."""
    counts = map_arrow(sets.select("shingles"), _counted, "key bigint, sets bigint").groupBy("key").agg(F.sum("sets").alias("sets"))
    top = counts.where(F.col("sets") >= COMMON).orderBy(F.col("sets").desc(), "key").limit(COMMON_LIST).toArrow()
    key = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], (len(key) - np.arange(len(key)))[order]


def _lists(sets: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(key, node, n, place)`` of the first shingles of each set in the final order."""
    known, rank = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for node, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                shingles = np.frombuffer(blob, np.uint64)
                late = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
                    late = np.where(known[at] == shingles, rank[at], 0)
                take = int(_prefix(np.array([n]))[0])
                columns[0].append(shingles[np.lexsort((shingles, late))][:take].view(np.int64))
                for c, x in zip(columns[1:], (np.full(take, node), np.full(take, n), np.arange(take))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in columns],
                                             names=["key", "node", "n", "place"])

    return map_arrow(sets, run, "key bigint, node bigint, n bigint, place bigint")


class PrefixTree:
    """Ordered sets of integers in a tree; ``linked`` finds those that link with one more set.

    A branch holds all elements up to the next fork, so sets that share no path cost one branch each.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.elements, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # what most sets have comes first: long shared paths
        order = np.lexsort((self.elements, -counts))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        ends = np.cumsum([len(s) for s in sets])
        place = self.place[place]
        paths = [np.sort(place[end - len(s): end]) for s, end in zip(sets, ends)]
        # sets by their paths: those that share one stand together
        keys = [path.astype(">u4").tobytes() for path in paths]
        self.sets = sorted(range(len(sets)), key=keys.__getitem__)
        paths = [paths[k] for k in self.sets]
        self.sizes = np.array([len(path) for path in paths])
        shared = np.array([0, *(_shared_start(a, b) for a, b in zip(paths[:-1], paths[1:]))])
        # a branch: its elements, where they end, first and last set below, its children
        self.root: list = [paths[0][:0], 0, 0, len(paths), []]
        todo = [self.root]
        while todo:
            _, depth, lo, hi, children = todo.pop()
            while lo < hi and self.sizes[lo] == depth:
                lo += 1
            if lo == hi:
                continue
            forks = [lo, *(lo + 1 + np.flatnonzero(shared[lo + 1: hi] <= depth)).tolist(), hi]
            for a, b in zip(forks[:-1], forks[1:]):
                end = int(shared[a + 1: b].min()) if b - a > 1 else int(self.sizes[a])
                child = [paths[a][depth:end], end, a, b, []]
                children.append(child)
                todo.append(child)

    def linked(self, probe: np.ndarray) -> list[int]:
        """Indices of the sets that link with the probe."""
        at = np.minimum(np.searchsorted(self.elements, probe), len(self.elements) - 1)
        have = np.zeros(len(self.elements) + 1, np.int64)
        have[self.place[at[self.elements[at] == probe]]] = 1
        until = np.concatenate([[0], np.cumsum(have)])
        size, out = len(probe), []
        todo = [(self.root, 0)]
        while todo:
            (_, depth, lo, hi, children), overlap = todo.pop()
            while lo < hi and self.sizes[lo] == depth:
                if 100 * overlap >= PERCENT * (size + depth - overlap):
                    out.append(self.sets[lo])
                lo += 1
            for child in children:
                path, end, a, b, _ = child
                now = overlap + int(have[path].sum())
                sizes = self.sizes[a:b]
                left = min(int(sizes.max()) - end, int(until[-1] - until[path[-1] + 1]))
                if (100 + PERCENT) * (now + left) >= PERCENT * (size + int(sizes.min())):
                    todo.append((child, now))
        return out


def _shared_start(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two arrays have in common from their start."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted groups ``(center, part, node, shingles)``; the center itself is the row with ``node = center``."""
    group, members, center = None, {}, None

    def links() -> tuple[list[int], list[int]]:
        if center is None or not members:
            return [], []
        nodes = list(members)
        found = PrefixTree([members[x] for x in nodes]).linked(center)
        return [group[0]] * len(found), [nodes[k] for k in found]

    for batch in batches:
        a, b = [], []
        for c, part, node, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (c, part) != group:
                for out, more in zip((a, b), links()):
                    out += more
                group, members, center = (c, part), {}, None
            if node == c:
                center = np.frombuffer(blob, np.uint64)
            else:
                members[node] = np.frombuffer(blob, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    a, b = links()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)`` of the written candidate pairs ``(center, node)`` that link."""
    sizes = pairs.groupBy("center").agg(F.count("*").alias("members"))
    parts = (pairs.join(sizes, "center")
             .select("center", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / TREE_SETS)).cast("int").alias("part"), "node"))
    parts = written(parts.unionAll(parts.select("center", "part", F.col("center").alias("node"))).distinct(), "ngram-parts")
    rows = sets.select("node", "shingles").join(_small(parts), "node").select("center", "part", "node", "shingles")
    rows = rows.repartition("center", "part").sortWithinPartitions("center", "part")
    return map_arrow(rows, _verify, "a bigint, b bigint")


def _fitting(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _star_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """Each node with one node of another component that it shares most lists with."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)) + turn / 2.0)
    rows = lists.withColumn("band", band)
    first = rows.groupBy("key", "band").agg(F.min_by(
        F.struct("node", "component", "n"), F.xxhash64("component", "node", F.lit(turn))).alias("center"),
        F.min("component").alias("low"), F.max("component").alias("high"))
    first = first.where("low <> high").select("key", "band", "center")
    met = rows.join(first, ["key", "band"]).where(
        (F.col("component") != F.col("center.component")) & _fitting(F.col("n"), F.col("center.n")))
    shared = met.groupBy("node", F.col("center.node").alias("center")).agg(F.count("*").alias("shared"))
    return shared.groupBy("node").agg(F.max_by("center", F.struct("shared", "center")).alias("center")).select("center", "node")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, bits_0, ...)``: one bit a shingle, by its hash."""
    for batch in batches:
        blobs = batch.column(1).to_pylist()
        bits = np.zeros((len(blobs), 64 * BITMAP_LONGS), bool)
        for r, blob in enumerate(blobs):
            bits[r, (np.frombuffer(blob, np.uint64) % np.uint64(64 * BITMAP_LONGS)).astype(np.int64)] = True
        longs = np.packbits(bits, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(longs[:, i])) for i in range(BITMAP_LONGS)]],
                                         names=["node", *BITS])


BITS = [f"bits_{i}" for i in range(BITMAP_LONGS)]


def _lacking(a: str, b: str) -> Column:
    """Bits of one set that the other lacks: at least so many shingles are not common."""
    return F.expr(" + ".join(f"bit_count({x}{a} & ~{x}{b})" for x in BITS))


def _all_pairs(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components that share a list and can reach the overlap by size, place and bitmaps."""
    mixed = (lists.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low <> high").select("key"))
    rows = lists.join(mixed, "key")
    bits = map_arrow(sets.select("node", "shingles"), _bitmaps, ", ".join(f"{x} bigint" for x in ("node", *BITS)))
    rows = written(rows.join(bits, "node"), "ngram-mixed")
    other = rows.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "place", *BITS)])
    n, m, i, j = (F.col(c) for c in ("n", "n_b", "place", "place_b"))
    reach = F.least(i, j) + F.least(n - i, m - j)
    common = F.least(n - _lacking("", "_b"), m - _lacking("_b", ""))
    pairs = rows.join(other, "key").where(
        (F.col("component") != F.col("component_b")) & (F.col("node") < F.col("node_b")) & _fitting(n, m)
        & (F.least(reach, common) * (100 + PERCENT) >= (n + m) * PERCENT))
    return pairs.select(F.col("node").alias("center"), F.col("node_b").alias("node")).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    classes = written(map_arrow(docs, _classes, "doc_id bigint, n_shingles bigint, node bigint"), "ngram-classes")
    with_id = docs.where("doc_id IS NOT NULL")
    first = map_arrow(with_id, _first_shingles, "key bigint, n bigint, doc_id bigint, counted int")
    first = first.repartition(F.coalesce("key", "doc_id")).sortWithinPartitions("key", "n", "doc_id")
    active = map_arrow(first, _neighbours, "doc_id bigint, shared bigint", rows=1 << 16).groupBy("doc_id").agg(F.sum("shared").alias("shared"))
    wanted = (classes.where("node IS NOT NULL").join(active, "doc_id").where(F.col("shared") >= _least_shared(F.col("n_shingles")))
              .groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    sets = written(_sets_of(written(wanted, "ngram-wanted"), with_id), "ngram-sets")
    lists = written(_lists(sets, _common_shingles(sets)), "ngram-lists")
    # lists with one node only tell nothing
    shared = lists.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    lists = written(lists.join(shared, "key"), "ngram-lists-shared")
    links, labels = None, None
    for turn in range(STAR_ROUNDS + 1):
        if labels is None:
            now = lists.withColumn("component", F.col("node"))
        else:
            now = lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        pairs = written(_star_pairs(now, turn) if turn < STAR_ROUNDS else _all_pairs(now, sets), "ngram-pairs")
        if pairs.isEmpty():
            if turn < STAR_ROUNDS:
                continue
            break
        new = written(verified(pairs, sets), "ngram-links")
        if not new.isEmpty():
            links = new if links is None else links.unionAll(new)
            labels = connected_components(links, "ngram-components")
    nodes = classes.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("smallest"))
    if labels is None:
        named = nodes.select("node", F.col("smallest").alias("component_id"))
    else:
        nodes = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        smallest = nodes.groupBy("component").agg(F.min("smallest").alias("component_id"))
        named = nodes.join(smallest, "component").select("node", "component_id")
    return classes.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest ``doc_id``.

    Rows without a ``doc_id`` stay; rows that share one stay or go together.
    """
    gone = jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(_small(written(gone, "ngram-gone")), "doc_id", "left_anti").select(*docs.columns)


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Size of each document's set and the smallest document it reaches over links."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = f"""
WITH RECURSIVE w AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
 SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.reached FROM r JOIN e ON r.doc_id = e.x)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.reached) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
