"""Token counts at every prefix, by dynamic programming over prefixes.

For byte-pair encoding the tokens of a prefix are the tokens of a shorter prefix and one last token, and that last token
is the only one that fits: the pair it makes with the last token before it must encode to itself. So one pass over a
word gives the count at each of its prefixes without encoding any of them. A document's table holds, for every code
point, by how much the count of the prefix that ends there differs from the one before (a signed byte); its sum is the
document's count, its running sum answers "how many tokens has this prefix" and "how long a prefix fits in so many
tokens" without encoding again.

Texts are cut at spaces and newlines, which the vocabulary drops; parts are remembered up to ``MEMO`` per worker.
Other white space, contractions, special tokens' strings and letters that normalisation changes are handled on the
normalised part: it is put together from clusters (a letter and what may join it), cut into the vocabulary's pieces, and
each piece is counted at its prefixes. Where a text's prefix ends inside a cluster and so has another last letter, the
count goes on from the piece's table at the cluster's start. All of this is linear in the part, but for a cluster of
very many marks whose order normalisation changes: its own length counts with the square.

Defined cases: a null text is empty (0 tokens, empty table); special tokens' strings inside a text count as the library
counts them by default; equal rows give equal rows; other columns of ``docs`` are not used.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import sub

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, normalizers

from strata_spark.llm.tasks import map_arrow

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
MEMO = 600_000
#: Longer parts are not remembered.
MEMO_CHARS = 48
_PIECES = regex.compile(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_CONTRACTION = re.compile("'s|'t|'re|'ve|'m|'ll|'d")
_RUN = re.compile("L+|P+|N|S")
_UNNORMAL = normalizers.NFC()
_LOWER = normalizers.Lowercase()


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b in set(printable) else chr(256 + rest.index(b)) for b in range(256)]


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Letters that normalisation may join with the one before, marks aside."""
    pairs = (unicodedata.decomposition(chr(i)).split() for i in range(0x110000))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(seconds | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])))


class PrefixCounts:
    """Counts at all prefixes of a text, for one vocabulary file with word ends."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model["end_of_word_suffix"]
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        whole = set(map("".join, self.ranks)) | set(_byte_letters()) | {c + self.end for c in _byte_letters()}
        self.inner = {t for t in whole if not t.endswith(self.end)}
        self.last = {t[: -len(self.end)] for t in whole if t.endswith(self.end)}
        # every tail of a token: whether it is a token inside a word (1), one at a word's end (2), or neither
        self.tails = {t[i:]: 0 for t in self.inner | self.last for i in range(len(t))}
        for t in self.tails:
            self.tails[t] = (t in self.inner) + 2 * (t in self.last)
        self.letters = _byte_letters()
        self.fits: dict[tuple[str, str, bool], bool] = {}
        self.memo: dict[str, bytes] = {"": b""}
        self.words: dict[str, list[int]] = {}
        self.lower: dict[str, str] = {}
        self.kinds: dict[str, str] = {}
        self.starts: dict[str, bool] = {}
        self.normal: dict[str, str] = {}
        self.longest = max(map(len, self.tails))
        self.special = re.compile("|".join(map(re.escape, self.specials)) or "(?!)")
        self.limit = memo

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair merging of a few symbols, lowest rank first, leftmost first."""
        while len(symbols) > 1:
            ranks = [self.ranks.get(p, len(self.ranks)) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == len(self.ranks):
                break
            out, i = [], 0
            while i < len(symbols):
                if i < len(ranks) and ranks[i] == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _fit(self, a: str, b: str, final: bool) -> bool:
        """Whether ``a`` then ``b`` stay apart when encoded together."""
        key = (a, b, final)
        known = self.fits.get(key)
        if known is None:
            symbols = list(a + b)
            if final:
                symbols[-1] += self.end
            known = self._merged(symbols) == [a, b + self.end if final else b]
            if len(self.fits) < self.limit:
                self.fits[key] = known
        return known

    def _spelt(self, word: str) -> str:
        plain = word.isascii() and word.isprintable()
        return word if plain else "".join(map(self.letters.__getitem__, word.encode()))

    def _extend(self, spelt: str, tail: list[str], count: list[int], ends: set[int] | None) -> list[int]:
        """Goes on with last tokens and counts up to the end of ``spelt``; counts as if the word ended at each of ``ends``."""
        out, tails, fits = [], self.tails, self.fits
        for i in range(len(tail), len(spelt) + 1):
            inner, last, n = 0, 0, i - 1
            found = []
            while n >= 0:
                token = spelt[n:i]
                kind = tails.get(token)
                if kind is None:
                    break
                if kind:
                    found.append((n, token, kind))
                n -= 1
            final = ends is None or i in ends
            for n, token, kind in reversed(found):  # longest first
                before = tail[n]
                if kind & 1 and not inner:
                    fit = True if not before else fits.get((before, token, False))
                    if self._fit(before, token, False) if fit is None else fit:
                        inner = count[n] + 1
                        tail.append(token)
                if kind & 2 and final and not last:
                    fit = True if not before else fits.get((before, token, True))
                    if self._fit(before, token, True) if fit is None else fit:
                        last = count[n] + 1
            count.append(inner)
            if final:
                out.append(last)
        return out

    def word(self, word: str) -> list[int]:
        """Count at each code point's end, as if the word ended there (``word``: lower case, one kind of character)."""
        spelt = self._spelt(word)
        ends = set(accumulate(len(c.encode()) for c in word)) if len(spelt) > len(word) else None
        return self._extend(spelt, [""], [0], ends)

    def _known_word(self, word: str) -> list[int]:
        got = self.words.get(word)
        if got is None:
            got = self.word(word)
            if len(word) <= MEMO_CHARS and len(self.words) < self.limit:
                self.words[word] = got
        return got

    def _lower(self, c: str) -> str:
        """Lower case of a character that stays one character whatever stands beside it, else an empty string."""
        got = self.lower.get(c)
        if got is None:
            low = _LOWER.normalize_str(c)
            plain = unicodedata.category(c)[0] in "LNPS" and not "\u1100" <= c <= "\u11ff" and c != "'"
            got = self.lower[c] = low if plain and len(low) == 1 and _UNNORMAL.normalize_str(c) == c else ""
        return got

    def _kind(self, c: str) -> str:
        """L(etter), N(umber), S(pace) or P (the rest) of a normalised character, as the library cuts."""
        got = self.kinds.get(c)
        if got is None:
            cut = self.library.pre_tokenizer.pre_tokenize_str
            among = len(cut(f"a{c}a"))
            got = self.kinds[c] = "LS"[among - 1] if among < 3 else "PN"[len(cut(c + c)) - 1]
        return got

    def _starts(self, c: str) -> bool:
        """Whether nothing before the character changes how it and what follows are normalised."""
        got = self.starts.get(c)
        if got is None:
            first = unicodedata.normalize("NFD", c)[0]
            got = self.starts[c] = not unicodedata.combining(first) and first not in _joining()
        return got

    def _normal(self, cluster: str) -> str:
        got = self.normal.get(cluster)
        if got is None:
            got = self.library.normalizer.normalize_str(cluster)
            if len(cluster) <= MEMO_CHARS and len(self.normal) < self.limit:
                self.normal[cluster] = got
        return got

    def _partials(self, cluster: str) -> list[str]:
        """The normalised prefixes of a cluster."""
        if len(cluster) == 1:
            return [self._normal(cluster)]
        out, joined = [], ""
        for c in cluster:
            last = unicodedata.combining(joined[-1]) if joined else 0
            # a mark of the same class as the one before stays where it is
            joined = joined + c if last and last == unicodedata.combining(c) and _UNNORMAL.normalize_str(c) == c else \
                _UNNORMAL.normalize_str(joined + c)
            out.append(joined)
        return [self._normal(p) for p in out]

    def _scan(self, normal: str) -> tuple[list[int], list[tuple[int, int, str]]]:
        """Counts at all prefixes of a normalised part, and its pieces: start, count before, kind."""
        kinds = "".join(map(self._kind, normal))
        counts, pieces, at, before = [0] * (len(normal) + 1), [], 0, 0
        while at < len(normal):
            short = _CONTRACTION.match(normal, at) if normal[at] == "'" else None
            kind = "C" if short else kinds[at]
            stop = (short or _RUN.match(kinds, at)).end()
            if kind == "S":
                inside = [0]
            elif short:  # its prefixes are a sign and a letter
                inside = [*range(1, stop - at), self._known_word(short.group())[-1]]
            else:
                inside = self._known_word(normal[at:stop])
            pieces.append((at, before, kind))
            counts[at + 1: stop + 1] = [before + c for c in inside]
            before += inside[-1]
            at = stop
        return counts, pieces

    def _plain(self, part: str) -> list[int]:
        """Counts at each prefix of a part without special tokens' strings, by clusters of the normalised part."""
        bounds = [i for i, c in enumerate(part) if not i or self._starts(c)]
        ends: list[tuple[int, str]] = []  # of each prefix: normalised length of the clusters before, its own last cluster
        made, at = [], 0
        for a, b in zip(bounds, [*bounds[1:], len(part)]):
            partials = self._partials(part[a:b])
            ends += [(at, p) for p in partials]
            made.append(partials[-1])
            at += len(partials[-1])
        normal = "".join(made)
        counts, pieces = self._scan(normal)
        offsets: list[int] = []
        states: dict[int, tuple[str, list[str], list[int]]] = {}

        def other_end(at: int, last: str) -> int:
            """Count of ``normal[:at] + last`` where the text goes on otherwise."""
            i = bisect_right(pieces, at - 1, key=lambda p: p[0]) - 1
            if i < 0:
                return self._scan(last)[0][-1]
            for j in (i, i - 1):  # the last letters may become a contraction
                if j >= 0 and normal[pieces[j][0]] == "'" and at - pieces[j][0] < 3:
                    return pieces[j][1] + self._scan(normal[pieces[j][0]: at] + last)[0][-1]
            start, before, kind = pieces[i]
            same = 0
            while same < len(last) and kind in "LP" and self._kind(last[same]) == kind:
                same += 1
            if not same:
                return counts[at] + self._scan(last)[0][-1]
            if i not in states:
                stop = pieces[i + 1][0] if i + 1 < len(pieces) else len(normal)
                states[i] = (self._spelt(normal[start:stop]), [""], [0])
                self._extend(*states[i], set())
            if not offsets:
                offsets.extend(accumulate((len(c.encode()) for c in normal), initial=0))
            spelt, tail, count = states[i]
            upto = offsets[at] - offsets[start]
            base = max(0, upto - self.longest)
            more = spelt[base:upto] + self._spelt(last[:same])
            found = self._extend(more, tail[base: upto + 1], count[base: upto + 1], {len(more)})
            return before + found[-1] + self._scan(last[same:])[0][-1]

        return [counts[at + len(last)] if normal.startswith(last, at) else other_end(at, last) for at, last in ends]

    def _counts(self, part: str) -> list[int]:
        """Counts at each prefix of a part without spaces and newlines."""
        if part.isascii():
            lower = part.lower()
            if lower.isalpha():
                return self._known_word(lower)
            if lower[-1] in ".," and lower[:-1].isalpha():  # the sign is a token of its own
                inside = self._known_word(lower[:-1])
                return [*inside, inside[-1] + 1]
        lower = "".join(map(self._lower, part))
        if "<" in part and self.special.search(part):
            out, at = [], 0
            for m in self.special.finditer(part):  # up to its last character it is text
                before = out[-1] if out else 0
                inside = [0, *self._plain(part[at: m.end() - 1])]
                out += [before + c for c in inside[1:]]
                out.append(before + inside[m.start() - at] + 1)
                at = m.end()
            return out + [out[-1] + c for c in (self._plain(part[at:]) if at < len(part) else [])]
        if len(lower) != len(part):
            return self._plain(part)
        if lower.isalpha():
            return self._known_word(lower)
        out, before = [0] * len(part), 0
        at = 0
        for m in _PIECES.finditer(lower):
            out[at: m.start()] = [before] * (m.start() - at)
            inside = self._known_word(m.group())
            out[m.start(): m.end()] = [before + c for c in inside]
            before += inside[-1]
            at = m.end()
        out[at:] = [before] * (len(part) - at)
        return out

    def part(self, part: str) -> bytes:
        """Differences of the counts, a signed byte a code point."""
        got = self.memo.get(part)
        if got is None:
            counts = self._counts(part)
            got = array("b", map(sub, counts, [0, *counts[:-1]])).tobytes()
            if len(part) <= MEMO_CHARS and len(self.memo) < self.limit:
                self.memo[part] = got
        return got

    def table(self, text: str | None) -> bytes:
        """The prefix table of a text: one signed byte a code point."""
        parts = (text or "").replace("\n", " ").split(" ")
        found = list(map(self.memo.get, parts))
        if None in found:
            found = [self.part(p) if f is None else f for p, f in zip(parts, found)]
        return b"\0".join(found)


def tokens_of(table: bytes) -> int:
    return int(np.frombuffer(table, np.int8).sum(dtype=np.int64))


def tokens_at(table: bytes, chars: int) -> int:
    """Tokens of the prefix of so many code points."""
    return tokens_of(table[:chars])


def longest_prefix(table: bytes, budget: int) -> int:
    """Code points of the longest prefix that has at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounts:
    """One a worker: later tasks find its memory filled."""
    return PrefixCounts(path)


def prefix_tables(docs: DataFrame, path: str, limit: int = LIMIT, tables: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, chars_in_limit, prefix_table)`` of every row; ``tables=False`` leaves the last null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            made = [counts.table(t) for t in texts]
            n = [tokens_of(t) for t in made]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                pa.array([len(t) if k <= limit else longest_prefix(t, limit) for t, k in zip(made, n)], pa.int64()),
                pa.array(made if tables else [None] * len(made), pa.binary())],
                names=["doc_id", "n_bytes", "n_tokens", "chars_in_limit", "prefix_table"])

    return map_arrow(
        docs.select("doc_id", "text"), run, "doc_id bigint, n_bytes bigint, n_tokens bigint, chars_in_limit bigint, prefix_table binary")


def op4_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Bytes, tokens, whether the limit is passed and how many code points fit in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = prefix_tables(docs, path or public_tokenizers.path(VOCABULARY), tables=False)
    return found.select("doc_id", "n_bytes", "n_tokens", (found.n_tokens > LIMIT).alias("over_limit"), "chars_in_limit")
