"""Line deduplication across documents, with DataFrame functions only.

The text is split at newlines. A line's key is the line stripped of space and 0x09-0x0D at both ends with A-Z
lower-cased. Keys of at least ``min_chars`` code points that are found in at least ``min_docs`` documents keep their
lines only in the largest ``doc_id`` that holds them.

Key hashes are range-partitioned by (hash, doc_id), so that one key with a third of all rows is spread over several
partitions, and sorted inside them by document and position. In that order the first occurrence of a key stays. Each
sorted partition hands on at most one row a key, and these few rows say how many documents hold a key and which of
them keeps it; that goes back to each partition that holds the key. Keys are known by 64-bit hashes. What goes is
returned as one compressed bitmap a document (and block of 32,768 lines), not as text.

Defined cases: a null or empty text is one empty line; rows that share a ``doc_id`` count as one document, and each of
them has its own bitmap; a null ``doc_id`` is no document, its lines neither count nor go; an empty table gives an
empty table; columns other than ``doc_id`` and ``text`` are not touched by ``kept_text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata_spark.session import written

MIN_CHARS = 40
MIN_DOCS = 5
#: Lines of one bitmap, as bitmap_bit_position counts them.
BITMAP_LINES = 32768
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\u000b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _row_hash() -> Column:
    """Tells rows of one ``doc_id`` apart; equal rows have equal lines, so they may share a bitmap."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(h, doc_id, row_hash, pos)`` of every line whose key has ``min_chars`` code points."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", _row_hash().alias("row_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_chars).select("doc_id", "row_hash", "pos", _key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h"), "doc_id", "row_hash", "pos")


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(doc_id, row_hash, block, dropped)``: a set bit is a line that goes; documents that lose nothing are absent."""
    # written once: otherwise the lines would be cut and hashed again for the ranges and for each use
    found = written(long_lines(docs, min_chars).repartitionByRange(F.col("h"), F.col("doc_id").desc())
                    .sortWithinPartitions("h", F.col("doc_id").desc(), "pos")
                    .withColumn("part", F.spark_partition_id()), "long-lines")
    # one row a key and document, then one a key and range: both sums start on the sorted rows of a file. A document's
    # rows of a key are in one range, so the ranges' counts add up
    holders = found.groupBy("h", "part", "doc_id").agg(F.lit(1).alias("one"))
    ranges = written(holders.groupBy("h", "part").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")), "line-ranges")
    repeated = (ranges.groupBy("h").agg(F.sum("n").alias("n_docs"), F.max("last").alias("keeper"))
                .where(F.col("n_docs") >= min_docs).select("h", "keeper"))
    # the keeper goes to each range that holds its key, so a hot key's rows stay spread as the ranges are
    keepers = ranges.select("h", "part").join(repeated, "h")
    gone = found.join(keepers, ["h", "part"]).where(F.col("doc_id") < F.col("keeper"))
    return (gone.groupBy("doc_id", "row_hash", F.bitmap_bucket_number(F.col("pos") + 1).alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("pos") + 1)).alias("dropped")))


def _bit(bitmaps: Column, pos: Column) -> Column:
    """Whether the bit of line ``pos`` (from 0) is set; ``bitmaps`` maps a block to its bitmap."""
    bitmap = bitmaps[(F.floor(pos / BITMAP_LINES) + 1).cast("bigint")]
    within = pos % BITMAP_LINES
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, within % 8) == 1, F.lit(False))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped``, ``kept_text`` and ``drop_bitmaps`` (null: nothing goes).

    Columns of those names in ``docs`` are replaced.
    """
    own = ("n_lines", "n_dropped", "kept_text", "drop_bitmaps", "_row", "_lines")
    docs = docs.select(*[c for c in docs.columns if c not in own])
    maps = (drop_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).groupBy("doc_id", "row_hash")
            .agg(F.map_from_entries(F.collect_list(F.struct("block", "dropped"))).alias("drop_bitmaps"),
                 F.sum(F.bitmap_count("dropped")).alias("n_dropped")))
    maps = maps.select(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_row"), "drop_bitmaps", "n_dropped")
    joined = docs.join(maps, (docs.doc_id == maps._doc) & (_row_hash() == maps._row), "left").drop("_doc", "_row")
    kept = F.array_join(
        F.filter(_lines(F.col("text")), lambda x, i: ~_bit(F.col("drop_bitmaps"), i)), "\n")
    return joined.select(
        *docs.columns,
        F.size(_lines(F.col("text"))).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("drop_bitmaps").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
        "drop_bitmaps")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines before dropping, dropped lines, digest of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


KEY_SQL = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), " \
          f"'{UPPER}', '{LOWER}')"

OP7_SQL = f"""
WITH l AS (
 SELECT doc_id, n_lines, pos, line, {KEY_SQL} AS key FROM (
  SELECT doc_id, len(ls) AS n_lines, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) a) b),
k AS (
 SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= {MIN_CHARS}
 GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT l.*, coalesce(l.doc_id < k.keeper, false) AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""
