"""Vector code compression: product codes whose codebooks are trained by active-entry Lloyd rounds.

Vectors become integers and are cut into equal parts; each part position has a codebook. Besides its code every part stores the exact
distance to its entry. After a round only the entries whose components changed are active. A part whose own entry stayed fixed compares
just the active entries with the stored distance, since no other distance can have changed; a part whose entry moved looks at all
entries again. Equal distances go to the lower index both ways, so the codes equal those of a full search.

Each round reads the table the last one wrote, in Arrow batches, writes codes and distances, and takes componentwise sums per (part,
entry) with partial aggregation. Only the codebooks (parts x entries rows) go to the driver and the tasks; a round's table is
released once the next is written.

Defined results: vectors that are NULL, have another number of components, or hold a NULL, NaN or infinite component are left out.
Components beyond +-2**26 after scaling count as that bound. Starting entries are the smallest vec_ids (NULL ids last, ties by
vector); repeated rows count each. With fewer vectors than entries the codebooks are smaller; an empty table gives an empty result. NULL
labels form one group. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrace.llm.centroid_clustering import integer_vectors, matrix
from shoptrace.sources.tables import release, written

PARTS, ENTRIES, ROUNDS, DIMS, SCALE = 8, 16, 6, 64, 4096
FAR = np.iinfo(np.int64).max
COLUMNS = ["vec_id", "label", "v", "code", "distances"]


def closer(x: np.ndarray, entries: np.ndarray, numbers: np.ndarray, best: np.ndarray, code: np.ndarray) -> None:
    """Let each row of ``x`` go over to the first of these entries that is closer than ``best``, or as close and of lower index."""
    for j in numbers:  # ascending
        distance = ((x - entries[j]) ** 2).sum(axis=1)
        better = (distance < best) | ((distance == best) & (j < code))
        best[better], code[better] = distance[better], j


def recode(x: np.ndarray, entries: np.ndarray, active: np.ndarray, best: np.ndarray, code: np.ndarray) -> int:
    """Codes and distances, in place, after the entries marked ``active`` have moved; returns how many distances were computed."""
    fixed = ~active[code]
    moved = np.flatnonzero(active)
    near, stored = best[fixed], code[fixed]
    closer(x[fixed], entries, moved, near, stored)
    best[fixed], code[fixed] = near, stored
    rest = ~fixed
    far, none = np.full(int(rest.sum()), FAR), np.full(int(rest.sum()), len(entries))
    closer(x[rest], entries, np.arange(len(entries)), far, none)
    best[rest], code[rest] = far, none
    return len(stored) * len(moved) + len(none) * len(entries)


def coded(table: DataFrame, books: np.ndarray, active: np.ndarray) -> DataFrame:
    """``table`` (vec_id, label, v, code, distances) brought up to date with ``books`` (parts x entries x width)."""
    parts, _, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), parts * width)
            code = matrix(batch.column("code"), parts)
            best = matrix(batch.column("distances"), parts)
            for p in range(parts):
                own, near = code[:, p].copy(), best[:, p].copy()
                recode(v[:, p * width : (p + 1) * width], books[p], active[p], near, own)
                code[:, p], best[:, p] = own, near
            each = np.arange(0, code.size + 1, parts, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(each, a) for a in (code.astype(np.int16).ravel(), best.ravel())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), *lists], names=COLUMNS)

    return table.select(*COLUMNS).mapInArrow(work, table.select(*COLUMNS).schema)


def means(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of the parts of each entry; an unused entry stays."""
    parts, _, width = books.shape
    each = [F.struct(F.lit(p).alias("part"), F.get("code", F.lit(p)).alias("entry"), F.slice("v", p * width + 1, width).alias("x")) for p in range(parts)]
    rows = table.select(F.explode(F.array(*each)).alias("e")).select("e.*").groupBy("part", "entry")
    out = books.copy()
    for row in rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width))).collect():
        out[row.part, row.entry] = [s // row.n for s in row[3:]]
    return out


def train(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, v, code, distances) under the trained codebooks, and these (parts x entries x width)."""
    if dims % parts or not 0 < entries <= 256:
        raise ValueError("parts must divide dims, and an entry must fit one byte")
    spark = vectors.sparkSession
    nothing = [F.array_repeat(F.lit(0).cast(kind), parts).alias(c) for c, kind in (("code", "short"), ("distances", "long"))]
    table, path = written(integer_vectors(vectors, dims, scale, "label").select("vec_id", "label", "v", *nothing), "vectors")
    first = table.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    if not len(first):
        return table, books
    active = np.ones(books.shape[:2], bool)  # at first every entry is new
    for number in range(rounds + 1):
        table, new = written(coded(table, books, active), "codes")
        release(spark, path)
        path = new
        if number < rounds:
            moved = means(table, books)
            books, active = moved, (moved != books).any(axis=2)
    return table, books


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` (code: hexadecimal) with ``approximation``, the vector its entries stand for."""
    table = F.lit([[e.tolist() for e in book] for book in books / scale]) if books.size else F.lit(None).cast("array<array<array<double>>>")
    digits = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    pieces = [F.get(F.get(table, F.lit(p)), digits(p)) for p in range(len(books))]
    return codes.withColumn("approximation", F.concat(*pieces) if pieces else F.lit(None).cast("array<double>"))


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_report(vectors: DataFrame, **settings) -> DataFrame:
    """Per vector: code, squared error, error summed over its label, digest of the codebooks."""
    table, books = train(vectors, **settings)
    spelled = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda a, d: a + d)
    rows = table.select("vec_id", "label", spelled.alias("code"), error.alias("error"))
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def _oracle() -> str:
    """The same rounds with every part compared with every entry, unrolled."""
    ctes = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """v AS MATERIALIZED (SELECT r, p, i, CAST(floor(4096 * CAST(embedding[8 * p + i] AS DOUBLE)) AS BIGINT) AS x FROM kept,
            (SELECT unnest(range(0, 8)) AS p), (SELECT unnest(range(1, 9)) AS i))""",
        "c0 AS MATERIALIZED (SELECT p, CAST(r - 1 AS INTEGER) AS c, i, x FROM v WHERE r <= 16)",
    ]
    for n in range(ROUNDS + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (SELECT r, p, min(d) AS d, arg_min(c, (d, c)) AS c FROM (
            SELECT r, p, c, CAST(sum((v.x - w.x) * (v.x - w.x)) AS BIGINT) AS d FROM v JOIN c{n} w USING (p, i) GROUP BY ALL) GROUP BY ALL)""")
        if n < ROUNDS:
            ctes.append(f"""c{n + 1} AS MATERIALIZED (SELECT o.p, o.c, o.i, coalesce(CAST(m.x AS BIGINT), o.x) AS x FROM c{n} o LEFT JOIN (
                SELECT p, c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x
                FROM a{n} JOIN v USING (r, p) GROUP BY p, c, i) m USING (p, c, i))""")
    return f"""WITH {", ".join(ctes)},
        coded AS (SELECT r, string_agg(lower(lpad(to_hex(c), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, c, i)) FROM c{ROUNDS}) AS codebooks_sha256
        FROM coded JOIN kept USING (r)"""


ORACLE = _oracle()
