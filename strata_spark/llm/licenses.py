"""License scans by patience alignment.

A text and a template are lists of words (letters, digits and other non-ASCII characters; A-Z lower-cased). Words that
occur once in both are anchors; the longest increasing run of them is kept, and the gaps between are aligned in the same
way, down to equal words at both ends of a gap. Coverage is the share of the template's words that are aligned.

The whole text is searched in stretches that start at every half of the template's length, counted from the text's own
first word, and are 1.5 and 2.5 times as long as the template: a copy of up to twice its length lies whole in one of them,
wherever it stands. The place found is then aligned by itself as long as coverage rises. A stretch is aligned only if its
words, each at most as often as the template has it, could reach ``COVERAGE``; that bound loses nothing.

A line of a few words (``NAMES``) is looked for around each place where the license's own name stands word for word; the
words before and after it are aligned. One word in the line's place may differ or be missing where the line has five words
or more, so ``coverage`` can be below ``COVERAGE`` there, but never a word of the name. A label with several wordings is
reported once a text; of hits of one family (``FAMILIES``) that overlap, those with fewer words aligned are dropped.

Defined cases: a null or empty text has no license; repeated notices in a text count once, at the best place (then the
first); equal rows are reported each; a template without words matches nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata_spark.llm.license_texts import FAMILIES, NAMES, TEMPLATES
from strata_spark.llm.tasks import map_arrow
from strata_spark.llm.words import blocks, utf8, word_hashes

COVERAGE = 0.9
#: Halves of the template's length that a stretch has.
SHORT, LONG = 3, 5
#: Tiles counted at a time.
TILES = 4096
#: From so many words on a line may have one word changed.
ONE_CHANGED = 5
#: Everything else in ASCII separates words.
_PLAIN = np.full(256, 32, np.uint8)
for _b in range(256):
    if chr(_b).isalnum() and _b < 128 or _b >= 128:
        _PLAIN[_b] = _b


def increasing(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first number, in which the second increases."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        if at == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[at], last[at] = j, k
        back[k] = last[at - 1] if at else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: Sequence[int], template: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned positions (in text, in template), both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        pairs = sorted((place[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in place)
        anchors = increasing(pairs)
        if anchors:
            out += anchors
            ends = [(a - 1, c - 1), *anchors, (b, d)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(out)


class Templates:
    """License texts, ready to be looked for."""

    def __init__(self, templates: Sequence[tuple[str, str]], coverage: float = COVERAGE, names: Mapping[str, str] = NAMES) -> None:
        self.coverage = coverage
        self.texts = []
        self.lines = []
        for name, text in templates:
            words = self.words(pa.array([text]))[0]
            if text in names:
                own = self.words(pa.array([names[text]]))[0]
                at = next(i for i in range(len(words)) if np.array_equal(words[i: i + len(own)], own))
                self.lines.append((name, words[:at].tolist(), own, words[at + len(own):].tolist()))
            elif len(words):
                known, counts = np.unique(words, return_counts=True)
                self.texts.append((name, words, known, counts))
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t[2] for t in self.texts]]))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.known >> np.uint64(48)).astype(np.int64)] = True

    @staticmethod
    def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = utf8(texts)
        return word_hashes(_PLAIN[raw], offsets)

    @staticmethod
    def _sums(tiles: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of the values of each tile and the ``LONG - 1`` after it."""
        out = values.copy()
        for d in range(1, LONG):
            at = np.searchsorted(tiles, tiles + d)
            here = np.flatnonzero(tiles[np.minimum(at, len(tiles) - 1)] == tiles + d)
            out[here] += values[at[here]]
        return out

    def _starts(self, at: np.ndarray, row: np.ndarray, codes: np.ndarray, first: np.ndarray, text: tuple, step: int) -> Iterator[tuple[int, int]]:
        """(row, first word) of the stretches that could reach the coverage (``at``: words of interest, with row and code).

        Tiles of ``step`` words count from each row's first word; the tile of a copy's first aligned word starts a stretch.
        """
        _, template, known, counts = text
        need = self.coverage * len(template) - 1e-9
        own = self.local(known)[codes]
        mine = np.flatnonzero(own >= 0)
        # so many tiles a row that no stretch meets the next row's
        base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // step) + LONG)])
        tile = base[row[mine]] + (at[mine] - first[row[mine]]) // step
        tiles, place, n = np.unique(tile, return_inverse=True, return_counts=True)
        good = tiles[self._sums(tiles, n) >= need] if len(tiles) else tiles
        if not len(good):
            return
        # counts of single words only for the tiles of stretches with enough words
        near = np.searchsorted(good, tiles, "right") - 1
        used = (near >= 0) & (tiles - good[near] < LONG)
        number = np.cumsum(used) - 1
        kept = used[place]
        tiles = tiles[used]
        for lo in range(0, len(tiles), TILES):
            # a part has the tiles of the stretches that start in it
            part = tiles[lo: lo + TILES + LONG]
            inside = np.flatnonzero(kept & (number[place] >= lo) & (number[place] < lo + len(part)))
            code = (number[place[inside]] - lo) * len(known) + own[mine[inside]]
            table = np.bincount(code, minlength=len(part) * len(known)).reshape(len(part), -1)
            could = np.minimum(self._sums(part, table), counts).sum(axis=1) >= need
            for t in part[:TILES][could[:TILES]]:
                r = int(np.searchsorted(base, t, "right")) - 1
                yield r, int(first[r]) + int(t - base[r]) * step

    def local(self, known: np.ndarray) -> np.ndarray:
        """Number of each word of all templates among the words ``known`` (-1: none of them)."""
        out = np.full(len(self.known), -1, np.int64)
        out[np.searchsorted(self.known, known)] = np.arange(len(known))
        return out

    @staticmethod
    def _best(words: np.ndarray, starts: Sequence[tuple[int, int]], template: list[int]) -> list[tuple[int, int]]:
        """The longest alignment of the stretches, each aligned again at the place found as long as that is longer."""
        best: list[tuple[int, int]] = []
        for a, b in starts:
            found = align(words[a:b].tolist(), template)
            while found:
                found = [(a + i, j) for i, j in found]
                if len(found) <= len(best):
                    break
                best, (a, b) = found, (found[0][0], found[-1][0] + 1)
                if len(best) == len(template):
                    return best
                found = align(words[a:b].tolist(), template)
        return best

    def _line(self, words: np.ndarray, low: int, high: int, at: int, line: tuple) -> tuple[float, int, int, int] | None:
        """(coverage, first word, last word, words aligned) of a line whose own name is at ``at`` in the text ``low:high``."""
        _, before, own, after = line
        size, end = len(before) + len(own) + len(after), at + len(own)
        a, b = max(low, at - 2 * len(before) - 2), min(high, end + 2 * len(after) + 2)
        left, right = align(words[a:at].tolist(), before), align(words[end:b].tolist(), after)
        n = len(left) + len(own) + len(right)
        start, stop = a + left[0][0] if left else at, end + right[-1][0] if right else end - 1
        one_changed = size >= ONE_CHANGED and n == size - 1 and stop - start < size
        return (n / size, start, stop, n) if n / size >= self.coverage or one_changed else None

    def _found(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str, float, int, int, int]]:
        """(row, template, coverage, first word, last word, words aligned); words count from the block's first."""
        for line in self.lines:
            own = line[2]
            at = np.flatnonzero(words[: len(words) - len(own) + 1] == own[0]) if len(words) >= len(own) else []
            for k in at:
                r = int(np.searchsorted(first, k, "right")) - 1
                if k + len(own) <= first[r + 1] and np.array_equal(words[k: k + len(own)], own):
                    x = self._line(words, int(first[r]), int(first[r + 1]), int(k), line)
                    if x:
                        yield r, line[0], *x
        likely = np.flatnonzero(self.maybe[(words >> np.uint64(48)).astype(np.int64)])
        if not len(likely):
            return
        codes = np.minimum(np.searchsorted(self.known, words[likely]), len(self.known) - 1)
        likely, codes = (x[self.known[codes] == words[likely]] for x in (likely, codes))
        row = np.searchsorted(first, likely, "right") - 1
        for text in self.texts:
            name, template, *_ = text
            size, step = len(template), (len(template) + 1) // 2
            for r, a in self._starts(likely, row, codes, first, text, step):
                end = int(first[r + 1])
                found = self._best(words, [(a, min(end, a + n * step)) for n in (SHORT, LONG)], template.tolist())
                if len(found) / size >= self.coverage:
                    yield r, name, len(found) / size, found[0][0], found[-1][0], len(found)

    def search(self, texts: pa.Array) -> Iterator[tuple[int, str, float, int, int, int]]:
        """(row, template, coverage, first word, last word, words aligned) of the best place of each label."""
        raw_all, offsets_all = utf8(texts)
        for lo, hi in blocks(offsets_all):
            words, first = word_hashes(_PLAIN[raw_all[offsets_all[lo]: offsets_all[hi]]], offsets_all[lo: hi + 1] - offsets_all[lo])
            best: dict[tuple[int, str], tuple] = {}
            for r, name, *x in self._found(words, first):
                if (r, name) not in best or (-x[0], x[1]) < (-best[r, name][0], best[r, name][1]):
                    best[r, name] = tuple(x)
            for (r, name), x in best.items():
                family = next((f for f in FAMILIES if name in f), ())
                others = [best[r, other] for other in family if (r, other) in best]
                if not any((o[3], o[0]) > (x[3], x[0]) and o[1] <= x[2] and x[1] <= o[2] for o in others):
                    yield lo + r, name, x[0], x[1] - int(first[r]), x[2] - int(first[r]), x[3]


FOUND = "doc_id bigint, license string, coverage double, first_word bigint, last_word bigint, n_aligned bigint"


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row a document and license found in it; each document is read in one pass, nothing is shuffled."""
    templates = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Templates(templates, coverage).search
        for batch in batches:
            found = list(search(batch.column(1)))
            ids = batch.column(0).to_pylist() if found else []
            columns = list(zip(*[(ids[row], *rest) for row, *rest in found])) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=[f.split()[0] for f in FOUND.split(", ")])

    return map_arrow(docs.select("doc_id", "text"), run, FOUND)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses and notices found in all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
