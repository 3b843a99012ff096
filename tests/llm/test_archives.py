"""Manifest, ranked search and archives: brute force, round trips and the defined cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata_spark.llm import lexical_search, merkle, warc
from strata_spark.llm.queries import QUERIES

LOWER_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(nodes):
    """Root and, per leaf, (place, run) of each level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i:i + 8] for i in range(0, len(level), 8)]
        for leaf_no, place in enumerate(at):
            paths[leaf_no].append((place % 8, runs[place // 8]))
        at, level = [p // 8 for p in at], [h("".join(r)) for r in runs]
    return level[0], paths


def brute_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    found, subroots = [], []
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[2] == lang), key=lambda x: x[:3])
        root, paths = brute_tree([x[2] for x in mine])
        subroots.append(root)
        found.append([(x[3], x[2], p) for x, p in zip(mine, paths)])
    root, tops = brute_tree(subroots)
    out = []
    for part, subroot, top in zip(found, subroots, tops):
        for row, own, path in part:
            path = path + top
            claim = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                claim = leaf((*row[:4], row[4].translate(LOWER_AZ)))
            for place, run in path:
                claim = h("".join([*run[:place], claim, *run[place + 1:]]))
            proof = h("".join(x for place, run in path for j, x in enumerate(run) if j != place))
            out.append((row[0], own, subroot, root, proof, claim, claim == root))
    return sorted(out, key=str)


def manifest_rows(docs):
    found = merkle.manifest(docs, merkle.tampered()).withColumn("folded", merkle.fold(F.col("claim"), F.col("path")))
    rows = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded",
                        F.col("folded") == F.col("root")).collect()
    return sorted((tuple(r) for r in rows), key=str)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def test_manifest_edges(edge_docs, clashing_docs, no_docs):
    rows = [tuple(r) for r in edge_docs.select(*FIELDS).collect()]
    want = brute_manifest(rows)
    assert manifest_rows(edge_docs) == want
    assert manifest_rows(clashing_docs) == want
    assert manifest_rows(no_docs) == []


def test_manifest_sizes(spark):
    """Groups of one leaf, of full runs, of one more, of several blocks and of a partial last subtree two levels up."""
    rng = random.Random(5)
    sizes = {None: 1, "a": 8, "b": 9, "c": 64, "é": 65, "d": 513, "e": 4099, "": 2}
    ids = list(range(sum(sizes.values())))
    rng.shuffle(ids)
    rows = [(ids.pop(), "s", lang, 3, f"Text {i}") for lang, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert manifest_rows(docs) == brute_manifest(rows)


def test_manifest_repeats(spark):
    """One row a thousand times, among others with the same id."""
    rows = [(7, "s", "en", 1, "Same")] * 1000 + [(7, "s", "en", 1, "Other"), (None, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert manifest_rows(docs) == brute_manifest(rows)


def test_exchange_is_the_tree(spark, monkeypatch):
    """Small blocks, so that rounds and guests do the work: every number of leaves up to some hundred."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 0)
    sizes = [1, 2, 7, 8, 9, 16, 63, 64, 65, 73, 120, 200]
    rows = [(f"g{n}", i, h(f"{n} {i}"), 0) for n in sizes for i in range(n)]
    nodes = spark.createDataFrame(rows, "group string, key bigint, node string, tie bigint").withColumn("carried", F.struct("group", "key"))
    blocks, upper = merkle.forest(nodes)
    got = {(r.group, r.block): (r.root, [(p.digit, p.run) for p in r.path]) for r in upper.collect()}
    assert len(got) == len(rows)
    for n in sizes:
        root, paths = brute_tree([h(f"{n} {i}") for i in range(n)])
        assert [got[f"g{n}", i] for i in range(n)] == [(root, p) for p in paths], n


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER_AZ))


def brute_search(docs, items, top=10):
    bags = [(doc_id, Counter(t)) for doc_id, text in docs if (t := terms(text))]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, bag in bags:
            m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                    for t in terms(text) if t in bag)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def search_rows(docs, items, **how):
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **how).collect()), key=str)


ITEMS = "item_id bigint, text string"
WORDS = [f"w{i}" for i in range(60)] + ["Ünï", "漢字", "it's", "A-b_c", "x.y", "ABC", "abc", "😀9"]


def random_docs(n, seed, longest=60):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(i, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, longest)))) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 7])
def test_search_is_exact(spark, parts):
    docs = random_docs(400, 3) + [(900 + i, "w1 w2 abc Ünï w50") for i in range(40)] + [(None, "w1 w2 abc Ünï w50"), (905, "w3"), (-4, "w3 w3")]
    items = random_docs(30, 4, 12) + [(3, "w59 w59 w58"), (None, "abc w50"), (77, None), (78, "nowhere at all"), (79, "...")]
    want = brute_search(docs, items)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)
    assert search_rows(frame, spark.createDataFrame(items, ITEMS)) == want
    assert search_rows(frame, spark.createDataFrame(items, ITEMS), group_bytes=200) == want
    assert search_rows(frame, spark.createDataFrame(items, ITEMS), top=3) == brute_search(docs, items, 3)


def test_search_edges(spark, edge_docs, clashing_docs, no_docs):
    items = [(1, "one two W4999 x" + "x" * 19_999), (2, "a b E w17"), (2, "strasse straße ÜNÏCODE ünïcode")]
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    frame = spark.createDataFrame(items, ITEMS)
    assert search_rows(edge_docs, frame) == search_rows(clashing_docs, frame) == brute_search(rows, items)
    assert search_rows(no_docs, frame) == [] and search_rows(edge_docs, spark.createDataFrame([], ITEMS)) == []
    assert search_rows(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"), frame) == []


def test_bounds_hold_and_prune():
    """No bound is below its score, and far fewer pairs are scored than there are."""
    docs, items = random_docs(2000, 8, 200), random_docs(20, 9, 12)
    queries = lexical_search.Queries(items)
    counter = list(lexical_search._counter(queries)([pa.RecordBatch.from_arrays([pa.array([t for _, t in docs])], names=["text"])]))[0]
    counts = dict(zip(counter.column(0).to_pylist(), counter.column(1).to_pylist()))
    weights = lexical_search.np.array([math.floor(1000 * math.log((2 * counts[-1] + 2) / (2 * counts.get(t, 0) + 1)))
                                       for t in range(len(queries.terms))])

    class Watched(lexical_search.Searcher):
        def _rescore(self, block, bounds):
            for row, (_, words, impacts) in enumerate(block):
                for q in range(bounds.shape[1]):
                    assert bounds[row, q] >= lexical_search.Searcher.score(self, q, words, impacts)
            self.scored = 0
            super()._rescore(block, bounds)

    search = Watched(queries, weights, counts[-1], counts[-2])
    for lo, hashes, first in lexical_search._text_blocks(pa.array([t for _, t in docs])):
        search.take([i for i, _ in docs][lo:lo + len(first) - 1], hashes, first)
    assert search.scored < 0.25 * len(docs) * len(queries.ids)
    assert len({(q, d) for q, _, d, _ in search.rows()}) == 10 * len(queries.ids)


def test_search_of_long_texts(spark):
    """A text of a million characters is one block, and ranks as any other."""
    rng = random.Random(1)
    docs = [(1, " ".join(rng.choices([f"v{i}" for i in range(30_000)], k=160_000))), (2, "v1 v2 v3"), (3, "v1 " * 50_000)]
    items = [(1, "v1 v2 v3 v29999"), (2, "v777 v778 v1")]
    assert search_rows(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, ITEMS)) == brute_search(docs, items)


PAGES = "page_id bigint, url string, html string"


def brute_pages(rows):
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, url, html in rows:
        data = (html or "").encode()
        ids = [i for i in groups[html or ""] if i is not None]
        target = max(ids) if ids and len(data) >= 1000 and (page_id is None or page_id < max(ids)) else None
        out.append((page_id, url, "response" if target is None else "revisit", None if target is not None else data, len(data),
                    hashlib.sha1(data).hexdigest(), target))
    return sorted(out, key=str)


def archive_rows(spark, folder):
    return sorted((tuple(r)[:7] for r in ((*x[:3], None if x[3] is None else bytes(x[3]), *x[4:]) for x in
                                          warc.read_archives(spark, folder).collect())), key=str)


BIG = "é" * 400 + "x" * 300
PAGE_ROWS = ([(i, f"http://h/{i}", BIG) for i in range(200)] + [(300, "http://a b\r\nc", BIG + "1"), (301, None, BIG + "1"), (302, "", None),
             (303, "u", ""), (304, "u", "x" * 999), (305, "u", "x" * 999), (306, "u", "x" * 1000), (307, "u", "x" * 1000), (308, "u", "\r\n\r\n" * 10),
             (308, "u", "\r\n\r\n" * 10), (None, "n", BIG), (None, "n", "y" * 1500), (None, "m", "y" * 1500), (310, "long", "z" * 2_000_000),
             (-5, "minus", "w" * 1200), (400, "v", "w" * 1200), (400, "v", "w" * 1200), (400, "v2", "w" * 1200)])


def escaped(rows):
    return sorted(((r[0], r[1] and re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", r[1]), *r[2:]) for r in rows), key=str)


@pytest.mark.parametrize("file_bytes", [2000, 1 << 20])
def test_archives_round_trip(spark, file_bytes):
    pages = spark.createDataFrame(PAGE_ROWS, PAGES).withColumns({"range": F.lit("mine"), "payload": F.lit(1), "name": F.lit("x")}).repartition(4)
    folder = warc.write_archives(pages, file_bytes=file_bytes)
    assert archive_rows(spark, folder) == escaped(brute_pages(PAGE_ROWS))
    files = spark.read.parquet(f"{folder}/manifest").collect()
    assert sum(f.records for f in files) == len(PAGE_ROWS)
    # all files but the last of a range have reached the size
    last = {f.range: max(x.name for x in files if x.range == f.range) for f in files}
    assert all(f.bytes >= file_bytes for f in files if f.name != last[f.range])


def names_and_digests(spark, folder):
    return sorted((f.name, f.sha1, f.records) for f in spark.read.parquet(f"{folder}/manifest").collect())


def test_archives_follow_from_the_table(spark):
    """Other partitions, row orders and folders give the same files, byte for byte."""
    pages = spark.createDataFrame(PAGE_ROWS, PAGES)
    one = warc.write_archives(pages.repartition(3), file_bytes=5000)
    two = warc.write_archives(spark.createDataFrame(PAGE_ROWS[::-1], PAGES).repartition(7), file_bytes=5000)
    assert names_and_digests(spark, one) == names_and_digests(spark, two)
    for name, sha1, _ in names_and_digests(spark, one):
        with open(f"{one.removeprefix('file://')}/{name}", "rb") as f:
            assert hashlib.sha1(f.read()).hexdigest() == sha1


def test_repeated_attempt_and_strays(spark):
    """A second attempt of a task puts the same bytes in place; files outside the manifest are not read."""
    folder = warc.write_archives(spark.createDataFrame(PAGE_ROWS, PAGES), file_bytes=5000)
    before, rows = names_and_digests(spark, folder), archive_rows(spark, folder)
    local = folder.removeprefix("file://")
    row = (0, None, "0" * 64, True, "u", b"p", None)
    batch = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (
        pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.binary(), pa.int64()))], names=list("abcdefg"))
    first, second = (list(warc._writer(folder + suffix, 10)(iter([batch])))[0].to_pylist() for suffix in ("/again", "/again"))
    assert first == second
    with open(f"{local}/range-999999-00000.warc.gz", "wb") as f:
        f.write(b"half a file")
    assert names_and_digests(spark, folder) == before and archive_rows(spark, folder) == rows


def test_damage_is_seen(spark):
    folder = warc.write_archives(spark.createDataFrame(PAGE_ROWS[-3:], PAGES))
    name = spark.read.parquet(f"{folder}/manifest").first().name
    path = f"{folder.removeprefix('file://')}/{name}"
    import gzip

    with open(path, "rb") as f:
        data = gzip.decompress(f.read())
    with open(path, "wb") as f:
        f.write(gzip.compress(data.replace(b"www", b"wvw", 1)))
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, folder).collect()


def test_empty_archive(spark):
    folder = warc.write_archives(spark.createDataFrame([], PAGES))
    assert warc.read_archives(spark, folder).collect() == []


def test_record_fields():
    import gzip
    import io

    data = warc.page_record(5, "http://h/x", b"abc", "0" * 64, 0, None)
    (fields, block), = warc.records(io.BytesIO(gzip.decompress(data)))
    assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    assert block.endswith(b"\r\n\r\nabc") and fields["Content-Length"] == str(len(block))
    assert data == warc.page_record(5, "http://h/x", b"abc", "0" * 64, 0, None)
    revisit = warc.page_record(4, "http://h/y", b"abc", "0" * 64, 0, 5)
    (other, block), = warc.records(io.BytesIO(gzip.decompress(revisit)))
    assert other["WARC-Refers-To"] == fields["WARC-Record-ID"] and other["WARC-Type"] == "revisit" and b"abc" not in block


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_lexical_search", "op13_warc"])
def test_queries_by_brute_force(spark, sf_dir, name):
    got = sorted((tuple(r) for r in QUERIES[name](spark, sf_dir).collect()), key=str)
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c).collect()]
    if name.startswith("op11"):
        want = brute_manifest(read("documents", *FIELDS))
    elif name.startswith("op12"):
        want = brute_search(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    else:
        want = sorted(((r[0], r[4], r[5], r[2], r[6]) for r in brute_pages(read("pages", "page_id", "url", "html"))), key=str)
    assert got == want

