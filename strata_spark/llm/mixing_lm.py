"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text (A-Z lower-cased) is its UTF-8 bytes and an end; every symbol is spelt in bits by a Huffman code over the symbol
counts of the training documents. ``CONTEXTS`` predictors look at the last bytes, or at the word so far; each keeps, in a
table of fixed size, how often the next bit was 0 or 1 in a hashed (context, place in the code). The counts come from all
training documents: every task sums its own, Spark sums the tasks' blocks. For a text the predictors' log odds are
weighted and added (a logistic mixture); which weights are used is gated by which predictors know the context, and the
weights start equal for all texts and are refined by gradient steps while a text is read, after every ``STEP_BITS`` bits of
it, so they never see the bits they predict. The score is the sum of the bits' log10 probabilities, a probability over all
texts; ``bits_per_byte`` is the same in bits by the text's bytes, ``total_bits_per_byte`` that of all held-out or of all
training documents together.

The base score is the smoothed word unigram model of the contract. Counts of the ``FREQUENT`` most frequent words go to all
tasks, the rest is joined, so every word has its exact count.

Defined cases: a null text is empty (one token, the end); the empty training set gives equal bits and base 0.5 / 0.5;
a null ``doc_id`` belongs to the training documents; repeated rows are scored each; bits per byte of no bytes are null.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata_spark.llm.tasks import map_arrow
from strata_spark.llm.words import BYTE, LOWER, blocks, mix, powers, utf8, word_hashes
from strata_spark.session import written

FOLDS, HELD_OUT = 5, 1
#: Bytes before the symbol that a predictor looks at (0: the word so far), and the bits of its table's size.
CONTEXTS = ((2, 18), (3, 20), (4, 20), (0, 20))
START_WEIGHT = (0.15, 0.3, 0.35, 0.3)
RATE = 0.3
#: Bits between two updates of a text's weights, from its first bit to its last.
STEP_BITS = 256
#: Bytes of texts worked on at a time; scored ones are many, as steps of few texts cost as much as those of many.
BLOCK_BYTES, SCORED_BYTES = 1 << 20, 2 << 20
FREQUENT = 100_000
END = 256
_TABLE_BLOCKS = 64
#: Bytes whose contexts are hashed at a time.
LOOK_UP_BYTES = 128 << 10
#: Symbols whose slots are looked up at a time, and bits that are brought together for the next steps.
GROUP_SYMBOLS, GROUP_BITS = 1 << 12, 1 << 15
#: Factors of at most 1 + e^20 that are multiplied before a logarithm is taken; divides ``STEP_BITS``.
FACTORS = 32
#: Hash of a symbol.
SYMBOL = mix(np.arange(END + 2, 2 * END + 3, dtype=np.uint64))
#: Tasks a core that sum the context counts, at most.
TABLE_TASKS = 8


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code length, inner nodes and bits (one row a symbol) of a Huffman code; every symbol has a code."""
    heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    children, node = {}, len(counts)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        children[node] = (x, y)
        heapq.heappush(heap, (a + b, node, node))
        node += 1
    paths, todo = {}, [(node - 1, ())]
    while todo:
        at, path = todo.pop()
        if at < len(counts):
            paths[at] = path
        else:
            todo += [(child, (*path, (at - len(counts), bit))) for bit, child in enumerate(children[at])]
    lengths = np.array([len(paths[s]) for s in range(len(counts))])
    nodes, bits = np.zeros((2, len(counts), lengths.max()), np.int64)
    for s, path in paths.items():
        nodes[s, : len(path)] = [n for n, _ in path]
        bits[s, : len(path)] = [b for _, b in path]
    return lengths, nodes, bits


@dataclass
class Code:
    """Spelling of symbols in bits."""

    lengths: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    def __post_init__(self) -> None:
        # by symbol and place in its code, as one row
        self.width = self.nodes.shape[1]
        self.node_hashes = mix(np.arange(1, END + 2, dtype=np.uint64))[self.nodes].ravel()
        self.flat_bits = self.bits.ravel()
        self.signs = (2 * self.flat_bits - 1).astype(np.float32)

    def places(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every bit of the symbols the index of its symbol, and that of symbol and place in the code."""
        length = self.lengths[symbols]
        begin = np.cumsum(length) - length
        place = np.repeat(np.arange(len(symbols)), length)
        code = np.arange(len(place))
        code += (symbols * self.width - begin)[place]
        return place, code

    def spell(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Slots of each predictor and value of every bit of the rows, and the index of each row's first bit (with the end)."""
        symbols, within = symbols_of(raw, offsets)
        place, code = self.places(symbols)
        slots = [slots_of(context, place, self.node_hashes[code], bits)
                 for context, (_, bits) in zip(contexts_of(symbols, within), CONTEXTS)]
        return slots, self.flat_bits[code], self.first_bits(symbols, offsets)

    def first_bits(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        first = offsets[:-1] + np.arange(len(offsets) - 1)
        return np.concatenate([[0], np.cumsum(np.add.reduceat(self.lengths[symbols], first))])


def symbols_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the rows, bytes with an end after each row, and the place of each in its row."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    symbols = np.full(len(raw) + n, END, np.int64)
    row = np.repeat(np.arange(n), size)
    row += np.arange(len(raw))
    symbols[row] = LOWER[raw]
    within = np.arange(len(symbols))
    within -= np.repeat(offsets[:-1] + np.arange(n), size + 1)
    return symbols, within


def contexts_of(symbols: np.ndarray, within: np.ndarray, predictors=None, at: np.ndarray | slice = slice(None)) -> Iterator[np.ndarray]:
    """Hash of what each predictor (default: all) sees before each symbol (default) or those at some indices."""
    base = 0x100000001B3
    seen, known = 0, 0
    for k in range(len(CONTEXTS)) if predictors is None else predictors:
        order = CONTEXTS[k][0]
        if not order:
            yield mix(_word_so_far(symbols, within)[at])
            continue
        if order < known:
            seen, known = 0, 0
        for back in range(known + 1, order + 1):
            before = _symbol_before(symbols, within, back, at).view(np.uint64)
            if back > 1:
                seen *= np.uint64(base)
                seen += before
            else:
                seen = before
        known = order
        yield mix(seen + np.uint64((k + 1) * pow(base, order, 1 << 64) % (1 << 64)))


def _symbol_before(symbols: np.ndarray, within: np.ndarray, back: int, at: np.ndarray | slice) -> np.ndarray:
    """The symbol ``back`` places before; before the first byte of a row stands END."""
    if not isinstance(at, slice):
        return np.where(within[at] >= back, symbols[at - back], END)
    before = np.full(len(symbols), END, np.int64)
    if back < len(symbols):
        before[back:] = symbols[:-back]
        before[within < back] = END
    return before


def _word_so_far(symbols: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Hash of the bytes since the last byte that is no letter, digit or sign above space (that byte included)."""
    n = len(symbols)
    up, down = powers(max(16, int(n).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(np.append(BYTE, BYTE[:1])[symbols] * up[:n], out=total[1:])
    fresh = within == 0
    fresh[1:] |= symbols[:-1] <= 32
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return (total[:-1] - total[start]) * down[start] + (np.arange(n) - start).astype(np.uint64)


def slots_of(context: np.ndarray, place: np.ndarray, node_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Slots of the bits in a table of ``2**bits``."""
    slot = context[place]
    slot ^= node_hashes
    slot *= np.uint64(0x9E3779B97F4A7C15)
    slot >>= np.uint64(64 - bits)
    return slot.view(np.int64)


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    raw, offsets = utf8(texts)
    for lo, hi in blocks(offsets, limit):
        yield lo, raw[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (kind 0) and symbols (kind 1) of the training rows with their counts, summed inside the task."""
    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    symbols = np.zeros(END + 1, np.int64)
    held: list[np.ndarray] = []

    def summed() -> None:
        nonlocal words, counts
        found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        held.clear()
        words, at = np.unique(np.concatenate([words, found]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(words)).astype(np.int64)

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)],
                                          names=["kind", "key", "count"])

    for batch in batches:
        for _, raw, offsets in text_blocks(batch.column(0)):
            held.append(word_hashes(raw, offsets)[0])
            symbols[:END] += np.bincount(LOWER[raw], minlength=END)
            symbols[END] += len(offsets) - 1
        if sum(map(len, held)) > 1 << 20:
            summed()
        if len(words) > 1 << 21:  # what a task holds stays bounded; Spark sums what is given out twice
            yield rows(0, words, counts)
            words, counts = words[:0], counts[:0]
    summed()
    yield rows(0, words, counts)
    yield rows(1, np.arange(END + 1), symbols)


def _distinct(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct key and how often it is there (counted ``times`` each)."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    # sorted by the upper bits with the index below; keys with equal upper bits may alternate, which only makes more runs
    order = keys & ~low
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return order[starts], np.diff(np.append(starts, len(order))) if times is None else np.add.reduceat(times[order], starts)


def _context_counts(code: Code):
    """Counts of the 0 and 1 bits of every slot: what follows a context in a block is spelt once for all its places there."""
    # a shorter context follows from a longer one, so its places are looked for among the distinct longer ones
    by_order = sorted(range(len(CONTEXTS)), key=lambda k: -CONTEXTS[k][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << bits, np.int64) for _, bits in CONTEXTS]
        for batch in batches:
            for _, raw, offsets in text_blocks(batch.column(0)):
                symbols, within = symbols_of(raw, offsets)
                among, times = slice(None), None
                for k in by_order:
                    order, bits = CONTEXTS[k]
                    if not order:
                        among, times = slice(None), None
                    context, = contexts_of(symbols, within, [k], among)
                    found, times = _distinct(context ^ SYMBOL[symbols[among]], times)
                    among = found if isinstance(among, slice) else among[found]
                    place, coded = code.places(symbols[among])
                    index = slots_of(context[found], place, code.node_hashes[coded], bits)
                    index *= 2
                    index += code.flat_bits[coded]
                    np.add.at(tables[k], index, times[place])
        for k, table in enumerate(tables):
            for b, part in enumerate(np.split(table, _TABLE_BLOCKS)):
                if part.any():
                    yield _block(k, b, part)

    return run


def _block(predictor: int, block: int, counts: np.ndarray) -> pa.RecordBatch:
    packed = zlib.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([predictor], pa.int32()), pa.array([block], pa.int32()), pa.array([packed], pa.binary())],
                                      names=["predictor", "block", "counts"])


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sorted rows of one block each."""
    key, total = None, None
    for batch in batches:
        for predictor, block, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (predictor, block) != key:
                if key:
                    yield _block(*key, total)
                key, total = (predictor, block), 0
            total = total + _unpacked(packed)
    if key:
        yield _block(*key, total)


BLOCKS = "predictor int, block int, counts binary"


@dataclass
class Mixer:
    """Log odds of every slot of each predictor, and the code."""

    code: Code
    odds: list[np.ndarray]

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each row."""
        first, odds, gate_of, other_of = self._looked_up(raw, offsets)
        n, gates = len(offsets) - 1, 1 << len(CONTEXTS)
        size = np.diff(first)
        steps = -(-size // STEP_BITS)
        # texts by descending number of steps: those still open are the first ones, a long text's steps cost as much as its own bits
        order = np.argsort(-steps, kind="stable")
        opened = n - np.cumsum(np.bincount(steps))[:-1]
        seg_end = np.cumsum(opened)
        # pieces of STEP_BITS, the first ones of all texts before the second ones
        turn = np.repeat(np.arange(len(opened)), opened)
        rank = np.arange(len(turn)) - (seg_end - opened)[turn]
        begin = first[:-1][order][rank] + STEP_BITS * turn
        take = np.minimum(size[order][rank] - STEP_BITS * turn, STEP_BITS)
        ends = np.cumsum(take)
        weights = [np.full(n * gates, w, np.float32) for w in START_WEIGHT]
        out = np.zeros(n)
        done = 0
        while done < len(opened):
            # the bits of some turns are brought together at once
            lo = seg_end[done] - opened[done]
            till = max(done + 1, int(np.searchsorted(ends[seg_end - 1], ends[lo] - take[lo] + GROUP_BITS, "right")))
            hi = seg_end[till - 1]
            starts, sizes = ends[lo:hi] - take[lo:hi], take[lo:hi]
            here = np.repeat(begin[lo:hi] - starts, sizes)
            here += np.arange(starts[0], ends[hi - 1])
            starts = starts - starts[0]
            inputs, other, gate = [x.take(here) for x in odds], other_of.take(here), gate_of.take(here)
            cell = np.repeat(np.arange(0, (hi - lo) * gates, gates), sizes)
            cell += gate
            seen = np.maximum(np.bincount(cell, minlength=(hi - lo) * gates), STEP_BITS // 8)
            # of most bits all predictors know the context: these are summed as they stand, the rest by cell
            rest = np.flatnonzero(gate != gates - 1)
            # odds of the bit that did not come: their logarithm's sum is finite however sure the prediction was
            missed = np.empty(len(here), np.float32)
            for now, seg in zip(opened[done:till], seg_end[done:till] - opened[done:till] - lo):
                a, b = starts[seg], starts[seg + now - 1] + sizes[seg + now - 1]
                own, cells, of_text = cell[a:b] - seg * gates, now * gates, starts[seg: seg + now] - a
                some = rest[rest.searchsorted(a): rest.searchsorted(b)] - a
                own_some = own[some]
                z = weights[0].take(own) * inputs[0][a:b]
                for w, x in zip(weights[1:], inputs[1:]):
                    z += w.take(own) * x[a:b]
                z *= other[a:b]
                np.maximum(z, -20, out=z)
                np.minimum(z, 20, out=z)
                pull = np.exp(z, out=missed[a:b])
                pull = pull * (other[a:b] / (1 + pull))
                rate = RATE / seen[seg * gates: seg * gates + cells]
                for w, x in zip(weights, inputs):
                    moved = pull * x[a:b]
                    total = np.zeros(cells)
                    if len(some):
                        total += np.bincount(own_some, weights=moved[some], minlength=cells)
                        moved[some] = 0
                    total[gates - 1:: gates] = np.add.reduceat(moved, of_text, dtype=np.float64)
                    total *= rate
                    w[:cells] -= total.astype(np.float32)
            out -= np.bincount(rank[lo:hi], weights=_log1p_sums(missed, starts, sizes), minlength=n)
            done = till
        scores = np.empty(n)
        scores[order] = out
        return scores / np.log(10)

    def _looked_up(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Index of each row's first bit (with the end); for every bit the predictors' log odds, the number of the gate, and -1
        where it is 1 and 1 where it is 0."""
        code = self.code
        n = int(code.lengths[LOWER] @ np.bincount(raw, minlength=END)) + (len(offsets) - 1) * int(code.lengths[END])
        odds = [np.empty(n, np.float32) for _ in CONTEXTS]
        gate, other = np.zeros(n, np.uint8), np.empty(n, np.float32)
        first, done = [np.zeros(1, np.int64)], 0
        for top, end in blocks(offsets, LOOK_UP_BYTES):
            symbols, within = symbols_of(raw[offsets[top]: offsets[end]], offsets[top: end + 1] - offsets[top])
            contexts = list(contexts_of(symbols, within))
            until = done + np.concatenate([[0], np.cumsum(code.lengths[symbols])])
            for lo in range(0, len(symbols), GROUP_SYMBOLS):
                hi = min(lo + GROUP_SYMBOLS, len(symbols))
                a, b = until[lo], until[hi]
                place, coded = code.places(symbols[lo:hi])
                nodes = code.node_hashes[coded]
                np.negative(code.signs[coded], out=other[a:b])
                for x, table, context, (_, bits) in zip(odds, self.odds, contexts, CONTEXTS):
                    found = x[a:b]
                    table.take(slots_of(context[lo:hi], place, nodes, bits), out=found, mode="clip")
                    gate[a:b] *= 2
                    gate[a:b] += found != 0
            first.append(until[offsets[top + 1: end + 1] - offsets[top] + np.arange(1, end - top + 1)])
            done = until[-1]
        return np.concatenate(first), odds, gate, other


def _log1p_sums(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of log(1 + x) over the runs, each cut into products of ``FACTORS``."""
    parts = -(-sizes // FACTORS)
    first = np.cumsum(parts) - parts
    cuts = np.repeat(starts - FACTORS * first, parts)
    cuts += FACTORS * np.arange(len(cuts))
    return np.add.reduceat(np.log(np.multiply.reduceat(x.astype(np.float64) + 1, cuts)), first)


def fit_mixer(train: DataFrame, symbols: np.ndarray) -> Mixer:
    """Predictors from the bits of all training texts; the tables' size is fixed by ``CONTEXTS``."""
    code = Code(*huffman(symbols))
    # a task's tables have the same size however little it reads: no more tasks than a few for each core
    tasks = TABLE_TASKS * train.sparkSession.sparkContext.defaultParallelism
    parts = map_arrow(train.select("text").coalesce(tasks), _context_counts(code), BLOCKS)
    sums = parts.repartition("predictor", "block").sortWithinPartitions("predictor", "block")
    tables = [np.zeros(2 << bits, np.int64) for _, bits in CONTEXTS]
    for row in map_arrow(sums, _block_sums, BLOCKS).toLocalIterator():
        width = len(tables[row.predictor]) // _TABLE_BLOCKS
        tables[row.predictor][row.block * width: (row.block + 1) * width] = _unpacked(row.counts)
    return Mixer(code, [np.log((t[1::2] + 0.4) / (t[::2] + 0.4)).astype(np.float32) for t in tables])


def _scorer(mixer: Mixer, known: np.ndarray, counts: np.ndarray, end_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, raw, offsets in text_blocks(batch.column(1), SCORED_BYTES):
                words, first = word_hashes(raw, offsets)
                n = len(offsets) - 1
                row = np.repeat(np.arange(n), np.diff(first))
                at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                hit = known[at] == words if len(known) else np.zeros(len(words), bool)
                base = np.bincount(row[hit], weights=np.log10(counts[at[hit]] + 0.5), minlength=n) + np.log10(end_count + 0.5)
                n_known = np.bincount(row[hit], minlength=n) + (end_count > 0)
                rare, per_row = words[~hit], np.bincount(row[~hit], minlength=n)
                rare_at = np.concatenate([[0], np.cumsum(per_row)])
                lists = pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), pa.array(rare.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at_row, at_row + n)), batch.column(0).slice(lo, n), batch.column(2).slice(lo, n),
                     pa.array(np.diff(first) + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(mixer.score(raw, offsets)),
                     pa.array(np.diff(offsets)), lists],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "rare"])
                at_row += n

    return run


def _bits_per_byte(score: Column, n_bytes: Column) -> Column:
    return F.when(n_bytes > 0, -score * F.lit(float(np.log2(10))) / n_bytes)


def score_texts(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte, total_bits_per_byte)``
    of every row."""
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    train = docs.where("NOT held_out")
    counted = written(map_arrow(train.select("text"), _token_counts, "kind int, key bigint, count bigint")
                      .groupBy("kind", "key").agg(F.sum("count").alias("count")), "lm-counts")
    words = counted.where("kind = 0").select("key", "count")
    symbols = np.zeros(END + 1, np.int64)
    for r in counted.where("kind = 1").collect():
        symbols[r.key] = r["count"]
    total = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n = int(total.n + symbols[END])
    v = int(total.v + (symbols[END] > 0))
    top = words.orderBy(F.col("count").desc(), "key").limit(frequent).toArrow()
    known, counts = top.column("key").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(known)
    known, counts = known[order], counts[order]
    mixer = fit_mixer(train, symbols)
    rows = written(map_arrow(
        docs, _scorer(mixer, known, counts, int(symbols[END])),
        "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, "
        "n_bytes bigint, rare array<bigint>"), "lm-rows")
    # no bytes: null
    per_byte = {r.held_out: r.x for r in rows.groupBy("held_out").agg(_bits_per_byte(F.sum("score"), F.sum("n_bytes")).alias("x")).collect()}
    rare = rows.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    joined = rare.join(words, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("count", F.lit(0)) + 0.5)).alias("rest"),
        F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("rest_known"))
    shift = float(np.log10(n + 0.5 * (v + 1)))
    return rows.drop("rare").join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(shift)).alias("base_score"), "score",
        "n_bytes", _bits_per_byte(F.col("score"), F.col("n_bytes")).alias("bits_per_byte"),
        F.when(F.col("held_out"), F.lit(per_byte.get(True)).cast("double")).otherwise(
            F.lit(per_byte.get(False)).cast("double")).alias("total_bits_per_byte"))


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    """Unigram base score and mixing-model score of all documents."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
