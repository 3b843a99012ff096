"""Merkle manifest of a table, with upper proofs by butterfly exchange.

Each row is a leaf, the digest of its fields; an absent field is ``-``, any other one its UTF-8 byte count, ``:`` and
its value. The leaves of a group (by default a language) are put in order, and every ``FANOUT`` consecutive nodes
become one until a single node, the group's root, is left. The groups' roots, in order, give the root of the table in
the same way.

Leaves are numbered over a range partitioning: sorted ranges are written, counted, and each row adds the count of the
ranges before its own. ``FANOUT ** BLOCK_LEVELS`` aligned leaves form a block, whose own levels are hashed in one row.
Above the blocks the exchange goes round by round: in round r blocks whose numbers differ in digit r only form a group
of at most ``FANOUT``, swap the roots of their subtrees, and each of them hashes the common parent for itself. So after
the last round each block holds its whole upper path, and nothing is sent down again. Where the last subtree of a round
has fewer blocks than its neighbours, its blocks also stand in, as guests, for those that it lacks.

Defined cases: rows are ordered by key (null first), then leaf digest; repeated rows are leaves of their own and equal
leaves are interchangeable; a null group is a group, ordered before all others; a null key is never tampered with; a
group of one row has that leaf as root; an empty table gives an empty table; columns other than the fields are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata_spark.session import written

FANOUT = 8
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels that a group of up to 2**60 leaves can have.
MAX_LEVELS = 20


def digest(parts: Column) -> Column:
    return F.sha2(parts, 256)


def leaf_digest(fields: Sequence[str] = FIELDS, replaced: Mapping[str, Column] | None = None) -> Column:
    """Digest of a row's fields; ``replaced`` gives other values for some of them."""
    values = [(replaced or {}).get(f, F.col(f)).cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
                             for v in values]))


def _height(total: Column) -> Column:
    """Levels above the leaves: the smallest h with ``FANOUT ** h >= total``."""
    return sum((F.when(total > F.lit(FANOUT**i), 1).otherwise(0) for i in range(MAX_LEVELS)), F.lit(0))


def _joined(nodes: Column) -> Column:
    return digest(F.array_join(nodes, ""))


def _run(nodes: Column, number: Column) -> Column:
    return F.slice(nodes, (number * FANOUT + 1).cast("int"), F.lit(FANOUT))


def _div(a: Column, b: int) -> Column:
    """Whole quotient of a number that is not negative."""
    return F.call_function("div", a, F.lit(b))


def _bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of ``value``, which is evaluated once however often the function names it."""
    return F.transform(F.array(value), function)[0]


def _parents(nodes: Column) -> Column:
    last = _div(F.size(nodes) - 1, FANOUT)
    return F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: _joined(_run(nodes, i)))


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """``nodes`` with ``pos`` in its group and the group's ``total``; the largest total."""
    ordered = written(
        nodes.repartitionByRange("group", "key", "node", "tie").sortWithinPartitions("group", "key", "node", "tie")
        .withColumn("at", F.monotonically_increasing_id()), "merkle-ordered")
    # the number holds the partition above its 33rd bit, and rows of a partition are numbered in their order
    part = F.shiftright("at", 33).alias("part")
    spans = ordered.groupBy("group", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole, before = Window.partitionBy("group"), Window.partitionBy("group").orderBy("part")
    spans = spans.select(
        "group", "part", "first", F.sum("n").over(whole).alias("total"),
        F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    largest = spans.agg(F.max("total").alias("n")).first().n or 0
    joined = ordered.withColumn("part", F.shiftright("at", 33)).join(spans, ["group", "part"])
    return joined.select("group", "node", "carried", "total", (F.col("at") - F.col("first") + F.col("before")).alias("pos")), largest


def _block_levels() -> list[Column]:
    """The nodes of a block's own levels, from the leaves up; a level that the group lacks repeats the one below."""
    levels = [F.transform("leaves", lambda x: x.node)]
    for k in range(1, BLOCK_LEVELS + 1):
        has = F.col("height") >= k
        levels.append(_bound(levels[-1], lambda x: F.when(has, _parents(x)).otherwise(x)))  # noqa: B023
    return levels


def exchange(blocks: DataFrame, rounds: int) -> DataFrame:
    """Blocks ``(group, block, total, height, root)`` with the path above each and the root of its group."""
    blocks = blocks.withColumn("path", F.expr("cast(array() as array<struct<digit:int,run:array<string>>>)"))
    count = F.ceil(F.col("total") / F.lit(FANOUT**BLOCK_LEVELS)).cast("bigint")
    for r in range(rounds):
        width = FANOUT**r
        subtree, offset = _div(F.col("block"), width), F.col("block") % width
        own = F.least(F.lit(width).cast("bigint"), count - subtree * width)
        # an only subtree has no neighbours to stand in for
        slots = F.when(subtree % FANOUT == 0, F.array(offset)).otherwise(F.sequence(offset, F.lit(width - 1).cast("bigint"), own))
        sent = blocks.select("*", _div(F.col("block"), width * FANOUT).alias("meet"), (subtree % FANOUT).cast("int").alias("digit"),
                             offset.alias("offset"), F.explode(slots).alias("slot"))
        met = Window.partitionBy("group", "meet", "slot")
        sent = sent.withColumn("run", F.transform(F.sort_array(F.collect_list(F.struct("digit", "root")).over(met)), lambda x: x.root))
        above = F.col("height") > BLOCK_LEVELS + r
        blocks = sent.where(F.col("slot") == F.col("offset")).select(
            "group", "block", "total", "height",
            F.when(above, _joined(F.col("run"))).otherwise(F.col("root")).alias("root"),
            F.when(above, F.concat("path", F.array(F.struct("digit", "run")))).otherwise(F.col("path")).alias("path"))
    return blocks


def forest(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and upper paths of nodes ``(group, key, node, tie, carried)``; ``group`` is not null.

    Blocks hold up to ``FANOUT ** BLOCK_LEVELS`` leaves each; ``upper`` has a row for each block with the root of its
    group and the path above the block.
    """
    numbered, largest = _numbered(nodes)
    blocks = written(
        numbered.groupBy("group", _div(F.col("pos"), FANOUT**BLOCK_LEVELS).alias("block"), "total")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "node", "carried"))).alias("leaves"))
        .withColumn("height", _height(F.col("total"))), "merkle-blocks")
    rounds = sum(FANOUT ** (BLOCK_LEVELS + r) < largest for r in range(MAX_LEVELS - BLOCK_LEVELS))
    upper = exchange(blocks.select("group", "block", "total", "height", _block_levels()[-1][0].alias("root")), rounds)
    return blocks, written(upper.select("group", "block", "root", "path"), "merkle-upper")


def leaves_of(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    """``(carried, node, path)`` of each leaf and the further columns of ``upper``.

    ``path`` has, from the leaf up, the leaf's place in each run and the run's nodes.
    """
    own = [c for c in upper.columns if c not in ("group", "block", "path")]
    both = blocks.join(upper.withColumnRenamed("path", "above"), ["group", "block"])

    def steps(i: Column) -> Column:
        inside = F.array(*[F.struct((_div(i, FANOUT**k) % FANOUT).cast("int").alias("digit"),
                                    _run(F.col(f"level{k}"), _div(i, FANOUT ** (k + 1))).alias("run")) for k in range(BLOCK_LEVELS)])
        return F.concat(F.slice(inside, F.lit(1), F.least(F.col("height"), F.lit(BLOCK_LEVELS))), F.col("above"))

    both = both.select("height", "leaves", "above", *own, *[c.alias(f"level{k}") for k, c in enumerate(_block_levels()[:-1])])
    found = both.select(*own, F.explode(F.transform("leaves", lambda x, i: F.struct(
        x.carried.alias("carried"), x.node.alias("node"), steps(i).alias("path")))).alias("x"))
    return found.select("x.carried", "x.node", "x.path", *own)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, step: _joined(F.transform(
        step.run, lambda x, j: F.when(j == step.digit, node).otherwise(x))))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    siblings = F.transform(path, lambda step: F.array_join(F.filter(step.run, lambda x, j: j != step.digit), ""))
    return _joined(siblings)


def manifest(docs: DataFrame, claim: Column | None = None, fields: Sequence[str] = FIELDS, group: str = "lang",
             key: str = "doc_id") -> DataFrame:
    """Per row: key, group, ``leaf``, ``subroot`` of the group, ``root``, ``path`` and ``claim``.

    ``claim`` is a leaf digest to be checked against the root, by default the row's own.
    """
    leaf = leaf_digest(fields)
    # digests are written before they are sorted, so the fields are read and hashed once
    nodes = written(docs.select(
        # a null group sorts before all others, and every key of a join is not null
        F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit("")).alias("group"), F.col(key).alias("key"), leaf.alias("node"),
        F.monotonically_increasing_id().alias("tie"),
        F.struct(F.col(key).alias("key"), F.col(group).alias("group"),
                 (leaf if claim is None else claim).alias("claim")).alias("carried")), "merkle-leaves")
    blocks, upper = forest(nodes)
    roots = upper.where("block = 0").select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("root").alias("node"),
                                            F.lit(0).cast("bigint").alias("tie"), F.struct("group").alias("carried"))
    top = leaves_of(*forest(roots)).select(F.col("carried.group").alias("group"), F.col("path").alias("table_path"),
                                           F.col("root").alias("table_root"))
    # the groups' paths are joined to blocks, of which there are far fewer than leaves
    upper = upper.join(top, "group").select("group", "block", F.concat("path", "table_path").alias("path"),
                                            F.col("root").alias("subroot"), F.col("table_root").alias("root"))
    return leaves_of(blocks, upper).select(
        F.col("carried.key").alias(key), F.col("carried.group").alias(group), F.col("node").alias("leaf"), "subroot", "root",
        "path", "carried.claim")


def tampered(key: str = "doc_id", text: str = "text") -> Column:
    """Leaf digest after tampering: where ``TAMPER_EVERY`` divides the key's checksum, A-Z of the text are lower-cased."""
    hit = F.crc32(F.col(key).cast("string")) % TAMPER_EVERY == 0
    return F.when(hit, leaf_digest(replaced={text: F.translate(text, UPPER, LOWER)})).otherwise(leaf_digest())


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof digest of every document, and the check of tampered documents against the root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = manifest(docs, tampered()).withColumn("folded_root", fold(F.col("claim"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD_SQL = " || ".join(f"coalesce(CAST(strlen(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')" for f in FIELDS)
_BENT_SQL = _FIELD_SQL.replace("CAST(text AS VARCHAR)", f"translate(text, '{UPPER}', '{LOWER}')")
# the checksum byte by byte, eight shifts a byte; the polynomial and the start value are those of CRC-32
_CRC_SQL = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
 lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT)),
 lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""

OP11_SQL = f"""
WITH RECURSIVE leaves AS (
 SELECT doc_id, lang, sha256({_FIELD_SQL}) AS leaf,
  CASE WHEN {_CRC_SQL} % 3 = 0 THEN sha256({_BENT_SQL}) ELSE sha256({_FIELD_SQL}) END AS claim FROM documents),
placed AS (
 SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up AS (
 SELECT lang, 0 AS level, pos, n, leaf AS node FROM placed
 UNION ALL
 SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1
 GROUP BY lang, level, pos // 8, n),
tops AS (
 SELECT lang, node, level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
 SELECT 0 AS level, pos, n, node FROM tops
 UNION ALL
 SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1
 GROUP BY level, pos // 8, n),
steps AS (
 SELECT p.doc_id, p.leaf, p.lang, u.level, u.pos, u.node, u.pos = p.pos // power(8, u.level)::BIGINT AS own
 FROM placed p JOIN up u ON p.lang IS NOT DISTINCT FROM u.lang AND u.pos // 8 = p.pos // power(8, u.level + 1)::BIGINT
 AND u.n > 1
 UNION ALL
 SELECT p.doc_id, p.leaf, p.lang, t.level + x.level, x.pos, x.node, x.pos = t.pos // power(8, x.level)::BIGINT
 FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang JOIN top x ON x.pos // 8 = t.pos // power(8, x.level + 1)::BIGINT
 AND x.n > 1),
proofs AS (
 SELECT doc_id, leaf, sha256(coalesce(string_agg(node, '' ORDER BY level, pos) FILTER (NOT own), '')) AS proof FROM steps
 GROUP BY doc_id, leaf),
runs AS (
 SELECT doc_id, leaf, level, coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos < mine), '') AS before_own,
  coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos > mine), '') AS after_own
 FROM (SELECT *, max(pos) FILTER (own) OVER (PARTITION BY doc_id, leaf, level) AS mine FROM steps) GROUP BY doc_id, leaf, level),
walk AS (
 SELECT doc_id, leaf, 0 AS level, claim AS node FROM placed
 UNION ALL
 SELECT w.doc_id, w.leaf, w.level + 1, sha256(r.before_own || w.node || r.after_own) FROM walk w
 JOIN runs r ON r.doc_id = w.doc_id AND r.leaf = w.leaf AND r.level = w.level),
folded AS (SELECT doc_id, leaf, arg_max(node, level) AS folded_root FROM walk GROUP BY doc_id, leaf)
SELECT p.doc_id, p.leaf, t.node AS subroot, x.node AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
 f.folded_root, f.folded_root = x.node AS verified
FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang JOIN (SELECT node FROM top WHERE n = 1) x ON true
LEFT JOIN proofs q ON q.doc_id = p.doc_id AND q.leaf = p.leaf JOIN folded f ON f.doc_id = p.doc_id AND f.leaf = p.leaf"""
