"""Exact token counts: a length histogram and what follows from it for every context limit.

Every whole text is encoded with a public byte-level vocabulary. Documents are counted by encoded length; that histogram is all
that is kept. Suffix sums over it give, for every length L that occurs, the documents and tokens at or above L and the
tokens left if each document is cut at L. Totals, quantiles and truncated totals for any limit are look-ups.

Suffix sums are taken in blocks of lengths, then over the blocks, so no task sorts the whole histogram.

Defined results: a NULL or empty text has length 0 and counts as a document. Repeated rows count each. Special-token strings in a
text are ordinary text. An empty table gives an empty histogram. Columns other than ``text`` are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptrace.llm.quality_rules import BYTE_PATTERN, vocabulary_folder
from shoptrace.sources.tables import materialise

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK_LENGTHS = 512


#: Blanks as the pattern of the vocabulary knows them, and a run of them that its matcher would have to go back over too far.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHOLE = r"(?s:.+)"
LONG_BLANK = re.compile(f"[{BLANK}]{{4096,}}")


@lru_cache(maxsize=4)
def encoding(folder: str, file: str, pattern: str = BYTE_PATTERN) -> tiktoken.Encoding:
    with open(os.path.join(folder, file), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, pieces: tiktoken.Encoding, whole: tiktoken.Encoding) -> int:
    """Tokens of the text, from the encoder and from one that takes any text as a single piece. Of a run of blanks all but the last one before other text are a single piece of the pattern, at
    the end of the text all are; long runs are given to the encoder as such pieces, so its matcher never sees them.
    """
    count = at = 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        count += len(pieces.encode_ordinary(text[at : run.start()])) + len(whole.encode_ordinary(text[run.start() : end]))
        at = end
    return count + len(pieces.encode_ordinary(text[at:]))


def encoded_lengths(docs: DataFrame, folder: str | None = None, file: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs), counted per batch already."""
    place = folder or vocabulary_folder()

    def run(batches):
        encoders = encoding(place, file), encoding(place, file, WHOLE)
        for batch in batches:
            lengths = [token_count(t, *encoders) if t else 0 for t in batch.column("text").to_pylist()]
            length, count = np.unique(np.array(lengths, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(count.astype(np.int64))], names=["n_tokens", "n_docs"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, **vocabulary) -> DataFrame:
    """Per encoded length: documents, and sums over all lengths from there on.

    ``docs_at_least``, ``tokens_at_least``; ``docs_below``; ``tokens_cut``: all tokens if documents are cut at this length.
    """
    counted = encoded_lengths(docs, **vocabulary).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    return suffix_sums(materialise(counted, "lengths"))  # read at several places; texts are encoded once


def suffix_sums(counted: DataFrame) -> DataFrame:
    block = F.floor(F.col("n_tokens") / BLOCK_LENGTHS)
    rows = counted.withColumn("_block", block).withColumn("_tokens", F.col("n_docs") * F.col("n_tokens"))
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    # blocks in turn lie in blocks: a length of 10**9 tokens has some 4,000 of these
    outer = blocks.withColumn("_outer", F.floor(F.col("_block") / BLOCK_LENGTHS))
    wholes = outer.groupBy("_outer").agg(F.sum("_d").alias("_od"), F.sum("_t").alias("_ot"))
    above = Window.orderBy(F.col("_outer").desc()).rowsBetween(Window.unboundedPreceding, -1)
    past = wholes.select("_outer", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c + "_past") for c in ("_od", "_ot")))
    inner = Window.partitionBy("_outer").orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    started = outer.join(past, "_outer").select(
        "_block",
        (F.col("_od_past") + F.coalesce(F.sum("_d").over(inner), F.lit(0))).alias("_docs_past"),
        (F.col("_ot_past") + F.coalesce(F.sum("_t").over(inner), F.lit(0))).alias("_tokens_past"),
    )
    own = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc())
    summed = rows.join(started, "_block").select(
        "n_tokens", "n_docs",
        (F.col("_docs_past") + F.sum("n_docs").over(own)).alias("docs_at_least"),
        (F.col("_tokens_past") + F.sum("_tokens").over(own)).alias("tokens_at_least"),
    )
    totals = summed.agg(F.max("docs_at_least").alias("d"), F.max("tokens_at_least").alias("t"))
    both = summed.withColumn("_d", totals.select("d").scalar()).withColumn("_t", totals.select("t").scalar())
    cut = F.col("_t") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")
    return both.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("_d") - F.col("docs_at_least")).alias("docs_below"), cut.alias("tokens_cut")
    )


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Per context limit: documents, documents cut, tokens kept, tokens lost."""
    table = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    per = [
        F.struct(
            F.lit(int(x)).cast("long").alias("context_limit"), F.col("n_docs").alias("d"),
            F.when(F.col("n_tokens") > x, F.col("n_docs")).otherwise(0).alias("cut"),
            (F.least(F.col("n_tokens"), F.lit(int(x))) * F.col("n_docs")).alias("kept"), (F.col("n_tokens") * F.col("n_docs")).alias("t"),
        )
        for x in limits
    ]
    rows = histogram.select(F.explode(F.array(*per)).alias("x")).select("x.*").groupBy("context_limit").agg(
        *(F.sum(c).alias(c) for c in ("d", "cut", "kept", "t"))
    )
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return table.join(rows, "context_limit", "left").select(
        "context_limit", none("d").alias("n_docs"), none("cut").alias("docs_cut"), none("kept").alias("tokens_kept"),
        none(F.col("t") - F.col("kept")).alias("tokens_lost"),
    )


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Per share q the least length that at least q of all documents do not exceed."""
    total = F.col("docs_below") + F.col("docs_at_least")
    up_to = F.col("docs_below") + F.col("n_docs")
    found = histogram.agg(*(F.min(F.when(up_to >= total * q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)))
    each = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares))))
    return found.select(each.alias("x")).select("x.*")
