"""Packing of token ids into training sequences: hierarchical, over several context sizes.

Every document's ids (ended by id 0) are cut into full windows of ``TIERS[0]`` and a rest. A rest is routed to the
smallest context size that holds it, and each tier is packed into windows of its own size, the longest tier first: a
window starts with the longest rest of its tier, and its gap is filled from shorter tiers, best fit first. Gaps of
longer windows may take ``1 - OWN_SHARE`` of a tier's ids; the others are kept for that tier's own windows. What is
still open takes the start of one more rest, whose other part is routed anew. So every window is full; only the last one
of a task may be padded, up to the context size it needs. The sequences of a task are dealt to step groups, the longest
first, each to the group with the fewest ids so far: groups mix the context sizes and have like numbers of ids.

Documents stream through a task in pools of ``POOL_TOKENS`` ids of rests; what a pool leaves open goes on to the next.
No row meets another task, so there is no shuffle, and a lost task gives the same sequences again.

Defined cases: a null text is empty and has the one id 0; equal rows are packed apart; the ids depend on the text only; a
text with white space too long for the fast encoder's patterns is encoded by the other library, with the same ids.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heapreplace

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from strata_spark.llm.tasks import map_arrow

VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks; gives the same ids three times as fast.
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
END_ID = 0
#: Context sizes, longest first; powers of two.
TIERS = (1024, 512, 256, 128)
#: Share of a tier's ids that gaps of longer windows leave to the tier's own windows.
OWN_SHARE = 0.5
POOL_TOKENS = 1 << 19
STEP_GROUP = 8


class Encoder:
    """Ids of a text as bytes (little-endian, four an id)."""

    def __init__(self, path: str, vocabulary: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens=SPECIAL)
        self.vocabulary = vocabulary
        self.library: Tokenizer | None = None

    def ids(self, text: str | None) -> bytes:
        try:
            found = self.encoding.encode_to_numpy(text or "", allowed_special="all")
        except ValueError:  # about a million white space characters in a row are too many for its patterns
            self.library = self.library or Tokenizer.from_file(self.vocabulary)
            found = self.library.encode(text, add_special_tokens=False).ids
        return np.asarray(found, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, vocabulary: str) -> Encoder:
    """One a worker."""
    return Encoder(path, vocabulary)


Piece = tuple[int, int, int]  # length, index of the document, start


class TierPacker:
    """Rests by tier; ``windows`` packs each tier and leaves fewer ids than one long window."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, own_share: float = OWN_SHARE) -> None:
        self.tiers = tiers
        self.own_share = own_share
        self.rests: list[list[Piece]] = [[] for _ in tiers]
        self.ids = [0] * len(tiers)

    @property
    def held(self) -> int:
        return sum(self.ids)

    def _tier(self, length: int) -> int:
        return max(i for i, size in enumerate(self.tiers) if size >= length)

    def add(self, piece: Piece) -> None:
        tier = self._tier(piece[0])
        insort(self.rests[tier], piece)
        self.ids[tier] += piece[0]

    def _take(self, tier: int, at: int) -> Piece:
        piece = self.rests[tier].pop(at)
        self.ids[tier] -= piece[0]
        return piece

    def _best_fit(self, gap: int, spare: list[int]) -> Piece | None:
        """The longest rest that fits, from the tier of the gap downwards, within what the tiers can spare."""
        for tier in range(self._tier(gap), len(self.tiers)):
            at = bisect_right(self.rests[tier], (min(gap, spare[tier]), float("inf"), 0))
            if at:
                spare[tier] -= self.rests[tier][at - 1][0]
                return self._take(tier, at - 1)
        return None

    def _start(self, tier: int, gap: int) -> Piece:
        """The start of the shortest rest of a tier, of a shorter one when that is used up; the other part is routed anew."""
        tier = next(t for t in [*range(tier, len(self.tiers)), *range(tier)] if self.rests[t])
        length, doc, start = self._take(tier, 0)
        if length > gap:
            self.add((length - gap, doc, start + gap))
        return min(length, gap), doc, start

    def _window(self, tier: int, spare: list[int]) -> list[Piece]:
        out, gap = [], self.tiers[tier]
        if self.rests[tier]:
            out.append(self._take(tier, -1))
            gap -= out[0][0]
        while gap and self.held:
            out.append(self._best_fit(gap, spare) or self._start(tier, gap))
            gap -= out[-1][0]
        return out

    def windows(self) -> Iterator[tuple[list[Piece], int]]:
        """Full windows with their sizes: each tier's own until its rests are used up."""
        for tier, size in enumerate(self.tiers):
            spare = [int(n * (1 - self.own_share)) if t > tier else n for t, n in enumerate(self.ids)]
            while self.rests[tier] and sum(self.ids[tier:]) >= size:
                yield self._window(tier, spare), size

    def last(self) -> Iterator[tuple[list[Piece], int]]:
        """What a task still holds after its windows, by the sizes it fills; what fills none is padded."""
        for tier, size in enumerate(self.tiers):
            while self.held >= size:
                yield self._window(tier, list(self.ids)), size
        if self.held:
            size = 1 << (self.held - 1).bit_length()
            yield self._window(len(self.tiers) - 1, list(self.ids)), size


RESULT = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, context bigint, step_group bigint, ids binary")


def _step_groups(sizes: list[int], full: int) -> list[int]:
    """Group of each sequence: the longest first, each to the group with the fewest ids so far."""
    groups = [(0, g) for g in range(max(1, sum(sizes) // (STEP_GROUP * full)))]
    heapify(groups)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        ids, out[i] = groups[0]
        heapreplace(groups, (ids + sizes[i], out[i]))
    return out


def _pack(path: str, vocabulary: str, tiers: tuple[int, ...], own_share: float, pool_tokens: int, keep_ids: bool):
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, full = encoder(path, vocabulary).ids, TierPacker(tiers, own_share), tiers[0]
        end = np.array([END_ID], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 32
        docs: dict[int, list] = {}  # index: id, ids, ids not yet given out
        made: list[tuple[list[Piece], int]] = []
        count = seen = 0

        def give(windows: list[tuple[list[Piece], int]]) -> pa.RecordBatch:
            nonlocal count
            rows = defaultdict(list)
            group_of = _step_groups([size for _, size in windows], full)
            for i, (pieces, size) in enumerate(windows):
                at = 0
                for length, doc, start in pieces:
                    doc_id, ids, open_ = docs[doc]
                    own = ids[4 * start: 4 * (start + length)]
                    for name, value in zip(names, (doc_id, start, length, zlib.crc32(own), len(ids) // 4, first + count + i, at,
                                                   size, first + count + group_of[i], own if keep_ids else None)):
                        rows[name].append(value)
                    at += length
                    docs[doc][2] = open_ - length
                    if open_ == length:
                        del docs[doc]
            count += len(windows)
            kinds = [pa.int64()] * 9 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(rows[n], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                docs[seen] = [doc_id, ids, n]
                made += [([(full, seen, at)], full) for at in range(0, n - full + 1, full)]
                if n % full:
                    packer.add((n % full, seen, n - n % full))
                seen += 1
                if packer.held >= pool_tokens:
                    made += packer.windows()
                if len(made) >= 512:
                    yield give(made)
                    made = []
        made += [*packer.windows(), *packer.last()]
        yield give(made)

    return run


def pack_documents(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS,
                   own_share: float = OWN_SHARE, pool_tokens: int = POOL_TOKENS, keep_ids: bool = True) -> DataFrame:
    """One row a piece, with its ids and the sequence (``context``: its padded length) it lies in.

    ``path`` and ``vocabulary`` are the same vocabulary as ranks and as the contract's file.
    """
    path, vocabulary = path or public_tokenizers.path(RANKS), vocabulary or public_tokenizers.path(VOCABULARY)
    return map_arrow(docs.select("doc_id", "text"), _pack(path, vocabulary, tiers, own_share, pool_tokens, keep_ids), RESULT)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, keep_ids=False).drop("ids")
