"""Shards of bounded bytes by extendible hashing.

A directory is indexed by leading bits of a hash of the key. It starts with one bucket; only a bucket above the byte limit is
split on one more bit, until every shard fits. Twelve bits are decided at a time: bytes are summed by the next twelve bits, and
within them every bucket gets the fewest bits with which it fits. Buckets that need more go into the next round. A directory
page has at most 4,096 entries for each bucket still too large, so no row meets a directory of the full depth.

The hash is the MD5 of doc_id, followed by the MD5 of the text, so rows of one hot key part as well: nothing is salted
by chance. All is DataFrame operations on (id, bytes, hash); texts are not shuffled. Sums are combined in the scan tasks.

Defined results: a bucket of one row, or of rows equal in doc_id and text, cannot be split and stays above the limit with ``fits``
false. A NULL text has no bytes; a NULL doc_id is a key of its own. Repeated rows lie in one shard. No rows give no rows. Extra
columns are ignored by ``assign`` and written by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptrace.sources.tables import materialise

LIMIT_BYTES = 2 << 20
PAGE_BITS = 12
_DIGITS = PAGE_BITS // 4
ROUNDS = 64 // _DIGITS


def hash_code(doc_id: Column, text: Column) -> Column:
    """64 hex digits: of the key, then of the text."""
    key = F.coalesce(doc_id.cast("string"), F.lit("\\N"))
    return F.concat(F.md5(key.cast("binary")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _page(live: DataFrame, limit: int, first: bool) -> DataFrame:
    """(parent, entry, depth): bits of this page that each entry's bucket needs; NULL where twelve are too few."""
    sums = [F.sum("n_bytes").alias("n_bytes"), F.min("same").alias("low"), F.max("same").alias("high")]
    entries = live.groupBy("parent", "entry").agg(*sums)
    depths = F.explode(F.sequence(F.lit(0 if first else 1), F.lit(PAGE_BITS)))
    each = entries.withColumn("depth", depths).withColumn("prefix", F.expr(f"shiftright(entry, {PAGE_BITS} - depth)"))
    whole = [F.sum("n_bytes").alias("n_bytes"), F.min("low").alias("low"), F.max("high").alias("high")]
    fits = (F.col("n_bytes") <= limit) | (F.col("low") == F.col("high"))
    good = each.groupBy("parent", "depth", "prefix").agg(*whole).filter(fits).select("parent", "depth", "prefix")
    chosen = each.join(good, ["parent", "depth", "prefix"]).groupBy("parent", "entry").agg(F.min("depth").alias("depth"))
    return entries.select("parent", "entry").join(chosen, ["parent", "entry"], "left")


def _directory(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """``doc_id, n_bytes, code, shard`` of each document."""
    code = hash_code(F.col("doc_id"), F.col("text"))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), code.alias("code")
    )
    live = materialise(narrow.withColumn("same", F.xxhash64("code")).withColumn("parent", F.lit("")), "hashed")
    done = []
    for turn in range(ROUNDS):
        entry = F.conv(F.substring("code", _DIGITS * turn + 1, _DIGITS), 16, 10).cast("int")
        live = live.withColumn("entry", entry)
        page = _page(live, limit_bytes, turn == 0)
        bits = F.lpad(F.bin("entry"), PAGE_BITS, "0")
        placed = live.join(page, ["parent", "entry"]).select("doc_id", "n_bytes", "code", "same", "parent", "depth", bits.alias("bits"))
        placed = materialise(placed, "placed")
        last = turn == ROUNDS - 1
        ready = placed if last else placed.filter("depth IS NOT NULL")
        shard = F.concat("parent", F.expr(f"substring(bits, 1, coalesce(depth, {PAGE_BITS}))"))
        done.append(ready.select("doc_id", "n_bytes", "code", shard.alias("shard")))
        live = placed.filter("depth IS NULL").select("doc_id", "n_bytes", "code", "same", F.concat("parent", "bits").alias("parent"))
        if last or live.limit(1).count() == 0:
            break
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return rows


def assign(docs: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, shard`` (its bits), ``depth, shard_bytes, shard_docs, fits``."""
    rows = _directory(docs, limit_bytes).select("doc_id", "n_bytes", "shard")
    totals = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return rows.join(totals, "shard").select(
        "doc_id", "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") <= limit_bytes).alias("fits")
    )


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES) -> str:
    """Write ``docs``, all columns, as one folder per shard, and return the name of the folders' column.

    Folders are named by the bits behind a ``b`` (``b`` alone is the undivided table), so that readers take the name as text. Their column
    is ``shard``, with underscores before it where ``docs`` has a column of that name.
    """
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    shards = _directory(docs, limit_bytes).select("code", F.concat(F.lit("b"), "shard").alias("name")).distinct()
    rows = docs.select(hash_code(F.col("doc_id"), F.col("text")).alias("code"), F.struct("*").alias("doc"))  # one column, so no names clash
    placed = rows.join(shards, "code").select(*(F.col("doc").getField(c).alias(c) for c in docs.columns), F.col("name").alias(name))
    placed.repartition(name).write.partitionBy(name).parquet(path)
    return name


#: The same in SQL: the fewest leading bits with which a document's bucket fits. 48 bits are enough for distinct keys.
ORACLE = f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS code
  FROM documents
), depths AS (SELECT unnest(range(0, 49)) AS depth),
buckets AS (
  SELECT depth, code >> (48 - depth) AS prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs
  FROM rows, depths GROUP BY ALL
), found AS (
  SELECT doc_id, n_bytes, code, min(b.depth) AS depth
  FROM rows r, depths d JOIN buckets b ON b.depth = d.depth AND b.prefix = r.code >> (48 - d.depth)
  WHERE b.shard_bytes <= {LIMIT_BYTES} OR b.shard_docs = 1 GROUP BY ALL
)
SELECT f.doc_id, f.n_bytes, substr(lpad(bin(f.code), 48, '0'), 1, CAST(f.depth AS INTEGER)) AS shard, CAST(f.depth AS INTEGER) AS depth,
  CAST(b.shard_bytes AS BIGINT) AS shard_bytes, b.shard_docs, b.shard_bytes <= {LIMIT_BYTES} AS fits
FROM found f JOIN buckets b ON b.depth = f.depth AND b.prefix = f.code >> (48 - f.depth)
"""
