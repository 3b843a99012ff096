"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last ``WINDOW`` bytes ends a chunk wherever it is one less than a multiple of the block size; each
chunk gives one character of a signature. Block sizes are ``3 * 2**level``; a fingerprint holds the signatures at one
size and at twice that size (``size:signature:signature``), so two texts whose sizes differ by one step can still be
compared. Likeness is twice the longest common subsequence by the sum of lengths (the edit distance with inserts and
deletes), 0 if the signatures share no run of ``GATE`` characters, 1 for equal fingerprints.

``in_order`` brings every document together with the next one of a total order without a global sort in one task: the
ids are cut into ranges, and the first document of each range is also sent to the range before.

Defined cases: a null text is an empty one, fingerprint ``3::``; a null ``doc_id`` comes after all others; rows that
share a ``doc_id`` are ordered by text; a table of one row is followed by itself; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata_spark.llm.tasks import map_arrow
from strata_spark.llm.words import BYTE, mix, span_hashes

WINDOW = 7
LENGTH = 64
SMALLEST = 3
GATE = 4
MAX_RUN = 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_STEP = np.uint32(0x01000193)


def _triggers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which a chunk may end, and the highest level at which it does."""
    rolling = np.zeros(len(raw), np.uint32)
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), raw.astype(np.uint32) + np.uint32(1)])
    for i in range(WINDOW):
        rolling = rolling * _STEP + padded[i: i + len(raw)]
    rolling = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    rolling = ((rolling ^ (rolling >> np.uint32(13))) & np.uint32(0x7FFFFFFF)) + np.uint32(1)
    at = np.flatnonzero(rolling % np.uint32(SMALLEST) == 0)
    blocks = rolling[at] // np.uint32(SMALLEST)
    return at, np.log2(blocks & (~blocks + np.uint32(1))).astype(np.int64)


def _signature(raw: np.ndarray, ends: np.ndarray, length: int) -> str:
    """One character a chunk; the last one takes all that is left."""
    ends = ends[: length - 1] + 1
    if not len(ends) or ends[-1] < len(raw):
        ends = np.append(ends, len(raw))
    starts = np.concatenate([[0], ends[:-1]])
    return _LETTERS[(mix(span_hashes(raw, starts, ends, BYTE)) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """``size:signature:signature at twice the size``."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return f"{SMALLEST}::"
    at, levels = _triggers(raw)
    level = max(0, math.ceil(math.log2(max(1.0, len(raw) / (SMALLEST * LENGTH)))))
    while level and np.count_nonzero(levels >= level) + 1 < LENGTH // 2:
        level -= 1
    first = _signature(raw, at[levels >= level], LENGTH)
    second = _signature(raw, at[levels >= level + 1], LENGTH // 2)
    return f"{SMALLEST << level}:{first}:{second}"


def _squeezed(s: str) -> str:
    """Runs of one character are cut to ``MAX_RUN``: they say little."""
    out, run = [], 0
    for i, c in enumerate(s):
        run = run + 1 if i and s[i - 1] == c else 1
        if run <= MAX_RUN:
            out.append(c)
    return "".join(out)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one integer operation a character of ``b``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _signature_likeness(a: str, b: str) -> float:
    a, b = _squeezed(a), _squeezed(b)
    runs = {a[i: i + GATE] for i in range(len(a) - GATE + 1)}
    if not any(b[i: i + GATE] in runs for i in range(len(b) - GATE + 1)):
        return 0.0
    return 2.0 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; signatures are compared only at block sizes that both fingerprints have."""
    if a == b:
        return 1.0
    (size_a, a1, a2), (size_b, b1, b2) = a.split(":"), b.split(":")
    size_a, size_b = int(size_a), int(size_b)
    if size_a == size_b:
        return max(_signature_likeness(a1, b1), _signature_likeness(a2, b2))
    if size_a == 2 * size_b:
        return _signature_likeness(a1, b2)
    if size_b == 2 * size_a:
        return _signature_likeness(a2, b1)
    return 0.0


def in_order(docs: DataFrame) -> DataFrame:
    """``(part, extra, doc_id, text)`` sorted by part and descending id; ``extra`` rows only follow the last of a part."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("bigint"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one row a range comes to the driver: its number is that of the partitions, whatever the table's size
    heads = [r.head for r in docs.select(key.alias("key")).repartitionByRange(wanted, F.col("key").desc())
             .groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("head")).collect()]
    heads = sorted(set(heads), reverse=True) or [0]
    n, bounds = len(heads), F.array(*[F.lit(h).cast("bigint") for h in heads])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    # ranges whose head is not below the key, found by doubling steps
    above = F.aggregate(steps, F.lit(0), lambda have, step: F.when(
        (have + step <= n) & (F.get(bounds, have + step - 1) >= F.col("key")), have + step).otherwise(have))
    rows = rows.withColumn("own", above - 1)
    own = F.struct(F.col("own").alias("part"), F.lit(False).alias("extra"))
    before = F.struct(F.pmod(F.col("own") - 1, F.lit(n)).cast("int").alias("part"), F.lit(True).alias("extra"))
    rows = rows.withColumn("to", F.when(F.get(bounds, F.col("own")) == F.col("key"), F.array(own, before)).otherwise(F.array(own)))
    rows = rows.withColumn("to", F.explode("to")).select("to.part", "to.extra", "key", "doc_id", "text")
    return (rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "extra", F.col("key").desc(), "text")
            .select("part", "extra", "doc_id", "text"))


RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, edited_text string")


def _compare_neighbours(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for part, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and held[0] != part:
                    held = None
                print_ = fingerprint(text)
                if held:
                    _, before_id, before, before_print = held
                    n = len(before)
                    edited = before[: n - n // 3] + text[: n // 3]
                    edited_print = fingerprint(edited)
                    out.append((before_id, n, hashlib.sha256(edited.encode()).hexdigest(), before_print, edited_print,
                                likeness(before_print, edited_print), likeness(before_print, print_),
                                edited if keep_text else None))
                held = None if extra else (part, doc_id, text, print_)
            columns = list(zip(*out)) if out else [()] * 8
            kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def fingerprints_with_edits(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Fingerprint of each text and of its edited text (last third replaced by the start of the next document)."""
    return map_arrow(in_order(docs), _compare_neighbours(keep_text), RESULT)


def op1_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, likeness to the edited text's and to the next document's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprints_with_edits(docs, keep_text=False).drop("edited_text")
