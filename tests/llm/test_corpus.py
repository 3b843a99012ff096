"""Operators over the whole corpus, and the pipeline, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from check_queries import compare, connect
from strata_spark.llm import components, line_dedup, mixing_lm, ngram_join, toxicity
from strata_spark.llm.queries import ORACLES, QUERIES
from strata_spark.session import written

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingle_set(text):
    w = words(text)
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    where, overlap, parent = defaultdict(list), Counter(), {d: d for d in texts}
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    for ds in where.values():
        overlap.update((a, b) for i, a in enumerate(ds) for b in ds[:i])

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for (a, b), n in overlap.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in texts}


def classes_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_ngram_query(spark, sf_dir, texts):
    assert classes_of(QUERIES["op5_ngram_join"](spark, sf_dir)) == brute_components(texts)


def near_copies(seed):
    """Chains of near copies, sets near the limit, a common passage, copies."""
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        w = [f"v{rng.randrange(4000)}" for _ in range(rng.choice((5, 6, 24, 60, 150)))]
        for _ in range(rng.randint(1, 14)):
            out.append(" ".join(w))
            for _ in range(rng.randint(0, 2)):
                w = list(w)
                w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
    passage = " ".join(f"p{i}" for i in range(40))
    out += [f"{passage} {' '.join(f't{k}x{i}' for i in range(rng.choice((2, 8, 20))))}" for k in range(25)]
    rng.shuffle(out)
    return {3 * i + 1: t for i, t in enumerate([*out, out[0].upper(), None, "", "x"])}


@pytest.mark.parametrize(("seed", "partitions"), [(1, 1), (2, 6)])
def test_ngram_join_of_near_copies(spark, seed, partitions, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE_SETS", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 5 if seed == 2 else 500_000)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 1)
    texts = near_copies(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(partitions)
    assert classes_of(ngram_join.jaccard_components(docs)) == brute_components(texts)


def test_prefix_tree():
    rng = random.Random(2)
    for _ in range(60):
        sets = [np.array(sorted(rng.sample(range(25), rng.randint(1, 20)))) for _ in range(8)]
        probe = np.array(sorted(rng.sample(range(25), rng.randint(1, 20))))
        want = []
        for k, s in enumerate(sets):
            n = len(set(s) & set(probe))
            if 100 * n >= 75 * (len(s) + len(probe) - n):
                want.append(k)
        assert sorted(ngram_join.PrefixTree(sets).linked(probe)) == want


def test_prefix_tree_has_a_branch_a_fork():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**62, 1000)
    sets = [np.append(common, rng.integers(0, 2**62, 50)) for _ in range(8)] + [common, common[:900], rng.integers(0, 2**62, 700)]
    sets = [np.unique(s.astype(np.uint64)) for s in sets]
    tree, branches = ngram_join.PrefixTree(sets), 0
    todo = [tree.root]
    while todo:
        branch = todo.pop()
        branches += 1
        todo += branch[-1]
    assert branches <= 2 * len(sets)
    for probe in (sets[0], sets[8], sets[9], sets[10]):
        want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(probe, s)) >= 75 * len(np.union1d(probe, s))]
        assert sorted(tree.linked(probe)) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {x: root(x) for x in got} and set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_ngram_cases(spark, edge_docs, no_docs, clashing_docs):
    assert ngram_join.jaccard_components(no_docs).count() == 0
    rows = ngram_join.jaccard_components(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    named = {r.doc_id: r for r in rows}
    assert (named[7].component_id, named[0].component_id, named[0].n_shingles, named[None].component_id) == (6, 0, 0, None)
    kept = ngram_join.keep_one_of_each(clashing_docs)
    assert kept.columns == clashing_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 6, 6, 8, 9, 10, 50]


def brute_lines(texts, min_docs=5):
    holders = defaultdict(set)
    key = {d: [x.strip(" \t\n\v\f\r").translate(LOW) for x in (t or "").split("\n")] for d, t in texts.items()}
    for d, ks in key.items():
        for k in ks:
            if len(k) >= 40:
                holders[k].add(d)
    out = {}
    for d, t in texts.items():
        ls = (t or "").split("\n")
        stay = [x for x, k in zip(ls, key[d]) if len(holders[k]) < min_docs or d == max(holders[k])]
        out[d] = (len(ls), len(ls) - len(stay), "\n".join(stay))
    return out


def test_line_query(spark, sf_dir):
    df = QUERIES["op7_line_dedup"](spark, sf_dir)
    assert compare(df, connect(sf_dir), ORACLES["op7_line_dedup"], [tuple(r) for r in df.collect()]) == []


def test_lines_against_brute_force(spark, no_docs):
    rng = random.Random(3)
    lines = [f"  Line {i} " + "x" * rng.choice((20, 28, 29, 60)) + "\t" for i in range(30)] + ["", "short", "é" * 39, "é" * 40]
    texts = {d: rng.choice(("\n", "\n\n")).join(rng.choice(lines) for _ in range(rng.randint(0, 12))) for d in range(60)}
    texts[60] = "\n".join(lines[i % 34] for i in range(70_000))  # more lines than one bitmap holds
    texts |= {61: None, 62: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute_lines(texts)
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_cases(spark, clashing_docs):
    found = line_dedup.dedup_lines(clashing_docs)
    assert found.count() == clashing_docs.count()
    row = {r.doc_id: r for r in found.collect()}[0]
    assert (row.n_lines, row.n_dropped, row.kept_text, row.h) == (1, 0, "", "mine")


@pytest.mark.parametrize("frequent", [7, 100_000])
def test_base_score(spark, sf_dir, texts, frequent):
    rows = {r.doc_id: r for r in mixing_lm.score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), frequent).collect()}
    tokens = {d: [*words(t), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_mixture_is_a_distribution_and_learns():
    lengths, nodes, bits = mixing_lm.huffman(np.arange(mixing_lm.END + 1))
    assert sum(2.0 ** -int(n) for n in lengths) == 1.0  # every bit string is one text's start
    code = mixing_lm.Code(lengths, nodes, bits)

    def spelt(texts):
        import pyarrow as pa
        return next((raw, offsets) for _, raw, offsets in mixing_lm.text_blocks(pa.array(texts)))

    flat = mixing_lm.Mixer(code, [np.zeros(1 << b, np.float32) for _, b in mixing_lm.CONTEXTS])
    raw, offsets = spelt(["abc", "", "Aé"])
    expected = [-(lengths[list(t.lower().encode())].sum() + lengths[mixing_lm.END]) * math.log10(2) for t in ("abc", "", "Aé")]
    assert flat.score(raw, offsets) == pytest.approx(expected)
    tables = [np.zeros(2 << b) for _, b in mixing_lm.CONTEXTS]
    slots, values, _ = code.spell(*spelt(["the cat sat on the mat. " * 40]))
    for t, s in zip(tables, slots):
        np.add.at(t, 2 * s + values, 1)
    trained = mixing_lm.Mixer(code, [np.log((t[1::2] + 0.4) / (t[::2] + 0.4)).astype(np.float32) for t in tables])
    raw, offsets = spelt(["the cat sat on the mat. the cat sat", "zq xj vk wpq zq xj vk wpq zq xj vk"])
    good, bad = trained.score(raw, offsets)
    assert good > 0.3 * bad
    # contexts seen a billion times, as every large corpus has them, leave no text impossible
    sure = mixing_lm.Mixer(code, [np.log((t[1::2] * 1e9 + 0.4) / (t[::2] * 1e9 + 0.4)).astype(np.float32) for t in tables])
    assert np.isfinite(sure.score(raw, offsets)).all() and np.isfinite(sure.score(*spelt(["the cat sat on the mat. the cow"]))).all()
    one_by_one = [trained.score(*spelt([t]))[0] for t in ("the cat sat on the mat. the cat sat", "zq xj vk wpq zq xj vk wpq zq xj vk")]
    assert [good, bad] == pytest.approx(one_by_one)  # a text's score depends on no other text


def test_mixture_updates_at_every_stride_of_a_long_text():
    import pyarrow as pa

    assert [order for order, _ in mixing_lm.CONTEXTS] == [2, 3, 4, 0]
    code = mixing_lm.Code(*mixing_lm.huffman(np.arange(mixing_lm.END + 1)))
    rng = np.random.default_rng(2)
    odds = [rng.normal(0, 1, 1 << b).astype(np.float32) * (rng.random(1 << b) < 0.7) for _, b in mixing_lm.CONTEXTS]
    texts = ["ab " * 2000, "the cat sat on the mat. " * 150, "", "x"]
    raw, offsets = next((raw, offsets) for _, raw, offsets in mixing_lm.text_blocks(pa.array(texts)))
    slots, bits, first = code.spell(raw, offsets)
    for r, got in enumerate(mixing_lm.Mixer(code, odds).score(raw, offsets)):
        xs = np.stack([o[s[first[r]: first[r + 1]]] for o, s in zip(odds, slots)]).astype(float)
        bit, n = bits[first[r]: first[r + 1]], mixing_lm.STEP_BITS
        weights, total = {}, 0.0
        for lo in range(0, len(bit), n):
            steps = {}
            for i in range(lo, min(lo + n, len(bit))):
                x, gate = xs[:, i], tuple(xs[:, i] != 0)
                w = weights.setdefault(gate, np.array(mixing_lm.START_WEIGHT))
                p = 1 / (1 + np.exp(-np.clip(w @ x, -20, 20)))
                total += math.log10(p if bit[i] else 1 - p)
                steps.setdefault(gate, []).append((bit[i] - p) * x)
            for gate, step in steps.items():
                weights[gate] = weights[gate] + mixing_lm.RATE * sum(step) / max(len(step), n // 8)
        assert got == pytest.approx(total, rel=1e-3)


def test_contexts_are_counted_once_for_all_their_places(monkeypatch):
    import pyarrow as pa

    texts = ["the cat sat on the mat. " * 400, "", None, "a", "The Cat\tsat ünïcode 漢字", "zzzz" * 300]
    code = mixing_lm.Code(*mixing_lm.huffman(np.arange(mixing_lm.END + 1)))
    expected = [np.zeros(2 << b, np.int64) for _, b in mixing_lm.CONTEXTS]
    for _, raw, offsets in mixing_lm.text_blocks(pa.array(texts)):
        slots, bits, _ = code.spell(raw, offsets)
        for table, slot in zip(expected, slots):
            np.add.at(table, 2 * slot + bits, 1)
    spelt, places = [], mixing_lm.Code.places
    monkeypatch.setattr(mixing_lm.Code, "places", lambda self, symbols: spelt.append(len(symbols)) or places(self, symbols))
    got = [np.zeros(2 << b, np.int64) for _, b in mixing_lm.CONTEXTS]
    for out in mixing_lm._context_counts(code)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])):
        predictor, block, packed = (out.column(i)[0].as_py() for i in range(3))
        got[predictor].reshape(mixing_lm._TABLE_BLOCKS, -1)[block] += mixing_lm._unpacked(packed)
    assert all((a == b).all() for a, b in zip(got, expected))
    assert 0 < sum(spelt) < sum(len(t or "") for t in texts) // 5


def test_scores_do_not_depend_on_the_texts_beside():
    import pyarrow as pa

    code = mixing_lm.Code(*mixing_lm.huffman(np.arange(mixing_lm.END + 1)))
    rng = np.random.default_rng(2)
    odds = [rng.normal(0, 1, 1 << b).astype(np.float32) * (rng.random(1 << b) < 0.7) for _, b in mixing_lm.CONTEXTS]
    mixer = mixing_lm.Mixer(code, odds)
    texts = ["ab " * 5000, "", "x", "some words " * 40, "", "q" * 999]

    def scores(some):
        return np.concatenate([mixer.score(raw, offsets) for _, raw, offsets in mixing_lm.text_blocks(pa.array(some))])

    alone = np.concatenate([scores([t]) for t in texts])
    assert np.allclose(scores(texts), alone, rtol=1e-12) and np.allclose(scores(texts[::-1])[::-1], alone, rtol=1e-12)


def test_bits_per_byte(spark, sf_dir, texts):
    rows = QUERIES["op6_lm_score"](spark, sf_dir).collect()
    for r in rows:
        assert r.n_bytes == len(texts[r.doc_id].encode())
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / r.n_bytes) if r.n_bytes else r.bits_per_byte is None
    for part in (True, False):
        own = [r for r in rows if r.held_out == part]
        total = -sum(r.score for r in own) / math.log10(2) / sum(r.n_bytes for r in own)
        assert [r.total_bits_per_byte for r in own] == pytest.approx([total] * len(own))


def test_language_model_cases(spark, edge_docs, no_docs, clashing_docs):
    assert mixing_lm.score_texts(no_docs).count() == 0
    rows = mixing_lm.score_texts(clashing_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].score == by_id[1].score and by_id[0].n_tokens == 1 and not by_id[None].held_out


def test_toxicity_on_held_out_labels(spark, no_docs):
    rng = random.Random(8)
    common, bad = [f"c{i}" for i in range(300)], ["nasty", "grimyword", "grimyother", "vile"]
    rows, labels = [], []
    for d in range(900):
        w = [rng.choice(common) for _ in range(rng.randint(5, 120))]
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
        if junk:
            w = [x + "%%%" for x in w]
        rows.append((d, " ".join(w)))
        labels.append((d, int(not junk), int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (2000, None)], "doc_id bigint, text string")
    known = spark.createDataFrame([*[x for x in labels if x[0] % 2], (None, 1, 1), (1, None, None), (5000, 1, 1)],
                                  "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit_chain(docs, known)
    p = {r.doc_id: r.p_toxic for r in toxicity.score_toxicity(docs, chain).collect()}
    held = [x for x in labels if x[0] % 2 == 0]
    assert np.mean([p[d] >= 0.5 for d, _, t in held if t]) > 0.9
    assert np.mean([p[d] >= 0.5 for d, _, t in held if not t]) < 0.02
    kept = toxicity.keep_non_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(d for d, x in p.items() if d is not None and x < 0.5)
    assert kept.where("doc_id IS NULL").count() == 1
    unlabelled = toxicity.fit_chain(docs, known.where("doc_id < 0"))
    assert toxicity.score_toxicity(docs, unlabelled).where("p_toxic > 0.001").count() == 0
    assert toxicity.score_toxicity(no_docs, chain).count() == 0


def test_pipeline_stages(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name != "packing" else None
        docs = written(stage(spark, docs, sf_dir), name)
        seen[name] = docs.count()
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        if name == "line_dedup":
            assert after == {d: x[2] for d, x in brute_lines(before).items()}
        elif name == "near_duplicates":
            assert set(after) == {root for _, root in brute_components(before).values()}
        else:
            assert all(after[d] == before[d] for d in after)
    assert seen["packing"] == corpus_pipeline.run(spark, sf_dir).count()
    assert hashlib.sha256(str(sorted(after)).encode()).hexdigest() == hashlib.sha256(
        str(sorted({r.doc_id for r in docs.select("doc_id").distinct().collect()})).encode()).hexdigest()
