"""Ranked lexical search with hashed max-sketches.

A document's impacts (one whole number for each of its terms) are folded into a sketch: each term falls on ``HASHES``
coordinates, a coordinate has the largest impact that falls on it, and the sketch's size is a power of two of at least
``SPREAD`` times the number of the document's different terms, so sketches of long and short texts are equally full. A
query takes the least of a term's coordinates; the weighted sum is never below the document's score. A task takes blocks of documents and a group of queries,
gets all upper bounds of a block in one lookup, and scores documents exactly by descending bound until the bound is below
the query's threshold, the score of the worst of the ``TOP`` that the task has so far. Equal bounds are scored as well,
so ties are settled by ``doc_id``. Tasks hand on at most ``TOP`` rows a query.

Weights and lengths need counts over all documents, which a first pass over the texts gathers: documents and terms in
all, and for each query term the documents that hold it. A term is known by a 64-bit hash; of n different terms two
are taken for one with a chance of about n squared by 2**65.

Bounds: queries go to the tasks in groups of about ``GROUP_BYTES`` of text; a task holds one block of texts (2 MB, or one
longer text, at some 40 bytes a byte) and ``TOP`` rows a query.

Defined cases: a null or empty text has no terms, as a document it is not counted and never found, as a query it gives
no rows; query rows that share an ``item_id``, or have none, are queries of their own with results of their own; documents
that share a ``doc_id`` are ranked each by itself, a null ``doc_id`` comes last among equal scores; with no documents or no
queries there are no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata_spark.llm.tasks import map_arrow
from strata_spark.llm.words import Spans, blocks, utf8

TOP = 10
SPREAD = 16
HASHES = 2
GROUP_BYTES = 1 << 20
#: Looked-up numbers that are held at a time.
LOOKUPS = 1 << 18
#: Parameters of the ranking rule, in whole numbers.
UNIT, SATURATION, PER_LENGTH, LENGTH_SHARE = 1_000_000_000, 1000, 8, 75
WEIGHT_UNIT = 1000

IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LAST_ID = -(2**64)


def term_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of the rows, in order, and the index of each row's first term (with the end)."""
    inside = IS_TERM[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    no = np.ones(1, bool)
    starts = np.flatnonzero(inside & (np.concatenate([no, ~inside[:-1]])[: len(raw)] | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], no])[: len(raw)] | edge[1:])) + 1
    return Spans(raw).hashes(starts, ends), np.searchsorted(starts, offsets)


def _text_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, term hashes and offsets of each block of rows."""
    raw, offsets = utf8(texts)
    for lo, hi in blocks(offsets):
        yield lo, *term_hashes(raw[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])


def coordinates(terms: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of terms in a sketch of ``size``, a power of two: one for each of ``HASHES`` parts of the hash."""
    return [((terms >> np.uint64(64 // HASHES * k)) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


class Queries:
    """Terms of a group of queries: ``terms`` are the different hashes, ``at`` the place of each query's terms in them."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        found = [(hashes[a:b], lo + i) for lo, hashes, first in _text_blocks(pa.array([t for _, t in items], pa.string()))
                 for i, (a, b) in enumerate(zip(first[:-1], first[1:])) if b > a]
        self.ids = [items[i][0] for _, i in found]
        self.numbers = [i for _, i in found]
        self.terms = np.unique(np.concatenate([h for h, _ in found])) if found else np.zeros(0, np.uint64)
        each = [np.searchsorted(self.terms, h) for h, _ in found]
        self.at = np.concatenate(each) if each else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


COUNTS = "term bigint, n bigint"
#: Rows of ``COUNTS`` that are no query term: documents with terms, terms of all documents.
N_DOCS, N_TERMS = -1, -2


def _counter(queries: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, n_docs, n_terms = np.zeros(len(queries.terms) + 1, np.int64), 0, 0
        for batch in batches:
            for _, hashes, first in _text_blocks(batch.column(0)):
                n_docs += int(np.count_nonzero(np.diff(first)))
                n_terms += len(hashes)
                at = np.searchsorted(queries.terms, hashes)
                if len(queries.terms):
                    known = queries.terms[np.minimum(at, len(queries.terms) - 1)] == hashes
                    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))[known]
                    pairs = np.unique(rows * len(queries.terms) + at[known])
                    holders += np.bincount(pairs % len(queries.terms), minlength=len(holders))
        held = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[N_DOCS, N_TERMS], held]).astype(np.int64)),
                                          pa.array(np.concatenate([[n_docs, n_terms], holders[held]]).astype(np.int64))],
                                         names=["term", "n"])

    return run


class Searcher:
    """The best documents that one task has found for each query of a group."""

    def __init__(self, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, top: int = TOP) -> None:
        self.queries, self.n_docs, self.n_terms, self.top = queries, n_docs, n_terms, top
        self.weights = weights[queries.at]
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
        self.least = np.ones(len(queries.ids), np.int64)
        self.scored = 0

    def impacts(self, counts: np.ndarray, length: int) -> np.ndarray:
        share = 100 - LENGTH_SHARE + LENGTH_SHARE * length * self.n_docs // self.n_terms
        return UNIT * counts // (SATURATION * counts + PER_LENGTH * share)

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """Upper bound of each query's score for each row of ``sketches``, all of one size."""
        q = self.queries
        places = [p[q.at] for p in coordinates(q.terms, sketches.shape[1])]
        step = max(1, LOOKUPS // max(1, len(q.at)))
        out = []
        for i in range(0, len(sketches), step):
            least = np.minimum.reduce([sketches[i: i + step, p] for p in places])
            out.append(np.add.reduceat(least * self.weights, q.starts[:-1], axis=1))
        return np.concatenate(out)

    def score(self, query: int, terms: np.ndarray, impacts: np.ndarray) -> int:
        a, b = self.queries.starts[query], self.queries.starts[query + 1]
        wanted = self.queries.terms[self.queries.at[a:b]]
        at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        self.scored += 1
        return int((self.weights[a:b] * impacts[at])[terms[at] == wanted].sum())

    def _keep(self, query: int, score: int, doc_id: int | None) -> None:
        entry, best = (score, LAST_ID if doc_id is None else -doc_id), self.best[query]
        if len(best) < self.top:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        if len(best) == self.top:
            self.least[query] = best[0][0]

    def take(self, ids: list[int | None], hashes: np.ndarray, first: np.ndarray) -> None:
        """Searches one block: all bounds first, then documents by descending bound as far as the threshold."""
        docs, by_size = [], {}
        if not self.queries.ids:
            return
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            if b > a:
                terms, counts = np.unique(hashes[a:b], return_counts=True)
                impacts = self.impacts(counts.astype(np.int64), int(b - a))
                size = 1 << max(4, (SPREAD * len(terms) - 1).bit_length())
                by_size.setdefault(size, []).append(len(docs))
                docs.append((ids[i], terms, impacts))
        bounds = np.zeros((len(docs), len(self.queries.ids)), np.int64)
        for size, members in by_size.items():
            # long texts are sketched a few at a time
            step = max(1, (LOOKUPS << 2) // size)
            for lo in range(0, len(members), step):
                part = members[lo: lo + step]
                sketches = np.zeros((len(part), size), np.int64)
                for row, d in enumerate(part):
                    for place in coordinates(docs[d][1], size):
                        np.maximum.at(sketches[row], place, docs[d][2])
                bounds[part] = self.bounds(sketches)
        self._rescore(docs, bounds)

    def _rescore(self, docs: list[tuple], bounds: np.ndarray) -> None:
        open_ = bounds >= self.least
        for query in np.flatnonzero(open_.any(axis=0)):
            column = bounds[:, query]
            rows = np.flatnonzero(open_[:, query])
            for row in rows[np.argsort(-column[rows], kind="stable")]:
                if column[row] < self.least[query]:
                    break
                doc_id, terms, impacts = docs[row]
                score = self.score(query, terms, impacts)
                if score >= self.least[query]:
                    self._keep(query, score, doc_id)

    def rows(self) -> Iterator[tuple[int, int | None, int | None, int]]:
        for number, item_id, best in zip(self.queries.numbers, self.queries.ids, self.best):
            for score, tie in best:
                yield number, item_id, None if tie == LAST_ID else -tie, score


FOUND = "query bigint, item_id bigint, doc_id bigint, score bigint"


def _searcher(queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(queries, weights, n_docs, n_terms, top)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hashes, first in _text_blocks(batch.column(1)):
                search.take(ids[lo: lo + len(first) - 1], hashes, first)
        columns = list(zip(*search.rows())) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def query_groups(items: DataFrame, group_bytes: int = GROUP_BYTES) -> Iterator[list[tuple[int | None, str | None]]]:
    """Queries in groups of about ``group_bytes`` of text, in order of id and text, read one partition at a time."""
    group, size = [], 0
    for r in items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        group.append((r.item_id, r.text))
        size += len(r.text or "") + 64
        if size >= group_bytes:
            yield group
            group, size = [], 0
    if group:
        yield group


def search(docs: DataFrame, items: DataFrame, top: int = TOP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each query, best first."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], f"part int, {FOUND}")
    for part, group in enumerate(query_groups(items, group_bytes)):
        queries = Queries(group)
        # at most one row for each term of the group comes to the driver
        counts = {r.term: r.n for r in map_arrow(docs.select("text"), _counter(queries), COUNTS)
                  .groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n_docs, n_terms = counts.get(N_DOCS, 0), counts.get(N_TERMS, 0)
        if not n_docs or not queries.ids:
            continue
        weights = np.array([math.floor(WEIGHT_UNIT * math.log((2 * n_docs + 2) / (2 * counts.get(t, 0) + 1)))
                            for t in range(len(queries.terms))], np.int64)
        rows = map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"),
                         _searcher(queries, weights, n_docs, n_terms, top), FOUND)
        found = found.unionAll(rows.select(F.lit(part).alias("part"), "*"))
    order = Window.partitionBy("part", "query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS_SQL = ("unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))")

OP12_SQL = f"""
WITH t AS (
 SELECT doc_id, {_TERMS_SQL} AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
tot AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS_SQL} AS term FROM benchmark) GROUP BY item_id, term),
scored AS (
 SELECT q.item_id, tf.doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
  * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
 FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term JOIN len ON len.doc_id = tf.doc_id, tot
 GROUP BY q.item_id, tf.doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10"""
