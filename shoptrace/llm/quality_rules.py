"""Quality rules by tokeniser fertility.

Public vocabularies measure every whole text: characters per token and byte-fallback share under a piece vocabulary with
byte fallback, characters per token under a byte-level vocabulary, and the entropy of the piece tokens. Words are encoded one
by one, each distinct word once (words are told apart by 64-bit hashes). Rejection bands come from the corpus itself: for every language (script where the
language is unknown) and length class, the median plus or minus a multiple of the quartile distance, from histograms over
all documents.

Defined results: a NULL or blank text has no words, fails the base rule and is not kept. Repeated rows are measured
each. A NULL language counts as its script. An empty table gives an empty result. Columns other than those read pass through
``filter_documents`` untouched and are ignored by ``measure``.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptrace.llm.shared import blocks, mix, prefix_sums, span_hashes, words_of
from shoptrace.sources.tables import materialise

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
PIECE_VOCABULARY = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: How a byte vocabulary's reference encoder cuts text before merging (fixed value of the public vocabulary).
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose encoding a Python worker remembers; beyond it the memory starts anew. A speed matter only.
REMEMBERED_WORDS = 2_000_000

#: Texts with fewer tokens get a wider share of their group's common band.
FULL_BAND_TOKENS = 1024
#: A class of so many documents lies half-way between its group's band and its own.
PRIOR_DOCUMENTS = 200

#: Histogram step of each metric.
METRICS = {"chars_per_token": 0.02, "chars_per_byte_token": 0.02, "fallback_share": 0.005, "entropy_ratio": 0.005}
SCHEMA = (
    "doc_id long, band_group string, length_class int, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, chars_per_token double, chars_per_byte_token double, fallback_share double, "
    "entropy_ratio double"
)


def vocabulary_folder() -> str:
    """Where the public vocabulary package is installed."""
    return os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)


class Encoder:
    """Token counts of single words under the two vocabularies; each word is encoded once and kept under its hash."""

    def __init__(self, folder: str, piece_file: str, byte_file: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, piece_file))
        with open(os.path.join(folder, byte_file), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("words", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.opens_word = np.zeros(max(ranks.values()) + 1, np.int64)
        self.opens_word[[rank for token, rank in ranks.items() if token[:1] == b" "]] = 1
        self.forget()

    def forget(self) -> None:
        empty = np.zeros(0, np.int64)
        self.old = self.fresh = (np.zeros(0, np.uint64), empty)  # sorted hashes, word numbers
        self.first, self.length, self.in_bytes, self.tokens = empty, empty, empty, np.zeros(0, np.int32)

    def byte_tokens(self, words: list[str]) -> np.ndarray:
        """Byte-level tokens of each word behind a blank, all words in one call: a token with a blank opens a word."""
        tokens = np.array(self.bytes.encode_ordinary(" " + " ".join(words)))
        number = np.cumsum(self.opens_word[tokens])
        if number[-1] != len(words):
            return np.array([len(self.bytes.encode_ordinary(" " + w)) for w in words], np.int64)
        return np.bincount(number - 1, minlength=len(words))

    def numbers(self, hashes: np.ndarray, spell) -> np.ndarray:
        """Word number of each hash; ``spell(places)`` gives the words of those not met before."""
        if len(self.first) > REMEMBERED_WORDS:
            self.forget()
        out = np.full(len(hashes), -1, np.int64)
        for known, number in (self.old, self.fresh):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                out = np.where(known[at] == hashes, number[at], out)
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self._learn(hashes[new], spell(new))
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> np.ndarray:
        ids = self.pieces.encode(words, num_threads=1)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        number = np.arange(len(words)) + len(self.first)
        self.first = np.concatenate([self.first, len(self.tokens) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.in_bytes = np.concatenate([self.in_bytes, self.byte_tokens(words)])
        self.tokens = np.concatenate([self.tokens, np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum()))])
        self.fresh = self._sorted([self.fresh, (hashes, number)])
        if 4 * len(self.fresh[0]) > len(self.old[0]):
            self.old, self.fresh = self._sorted([self.old, self.fresh]), (self.fresh[0][:0], self.fresh[1][:0])
        return number

    @staticmethod
    def _sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        hashes, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes)
        return hashes[order], numbers[order]


@lru_cache(maxsize=1)
def _encoder(folder: str, piece_file: str, byte_file: str) -> Encoder:
    return Encoder(folder, piece_file, byte_file)


#: First code point after each script's block, by rule of thumb; enough to tell scripts apart (fixed values).
SCRIPTS = [(0x250, "latin"), (0x400, "greek"), (0x530, "cyrillic"), (0x600, "hebrew"), (0x780, "arabic"), (0xE00, "indic")]


def script_of(text: str) -> str:
    """The script of most letters; 'none' without letters."""
    counts: dict[str, int] = {}
    for letter, n in _letters(text).items():
        name = next((s for end, s in SCRIPTS if ord(letter) < end), "east_asian" if ord(letter) >= 0x2E80 else "other")
        counts[name] = counts.get(name, 0) + n
    return max(sorted(counts), key=counts.get) if counts else "none"


def _letters(text: str) -> dict[str, int]:
    return {c: text.count(c) for c in set(text) if c.isalpha()}


def repeated_window_words(word: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Words per document that lie in a window of ``WINDOW`` words found twice or more in that document.

    ``word`` numbers the distinct words: windows whose hashes agree are compared number by number.
    """
    n = len(word)
    if n < WINDOW:
        return np.zeros(docs, np.int64)
    at = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    code = mix(word.astype(np.uint64) + np.uint64(1))
    value = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        value = value * np.uint64(0x9E3779B97F4A7C15) + code[k : n - WINDOW + 1 + k]
    value = mix(value[at] + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(value, kind="stable")
    near = np.flatnonzero(value[order][1:] == value[order][:-1])
    if not len(near):
        return np.zeros(docs, np.int64)
    left, right = at[order[near]], at[order[near + 1]]
    steps = np.arange(WINDOW)
    same = (word[left[:, None] + steps] == word[right[:, None] + steps]).all(axis=1) & (doc[left] == doc[right])
    found = np.unique(np.concatenate([left[same], right[same]]))
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, found, 1)
    np.add.at(mark, found + WINDOW, -1)
    return np.bincount(doc[np.cumsum(mark[:-1]) > 0], minlength=docs)


def measure_block(texts: list[str], data: np.ndarray, at: np.ndarray, encoder: Encoder) -> dict[str, np.ndarray]:
    docs = len(at) - 1
    start, end, doc = words_of(data, at)
    n_words = np.bincount(doc, minlength=docs)
    hashes, first, number = np.unique(span_hashes(prefix_sums(data), start, end), return_index=True, return_inverse=True)
    raw = data.tobytes()

    def spell(places: np.ndarray) -> list[str]:
        at_words = zip(start[first[places]].tolist(), end[first[places]].tolist(), strict=True)
        return [raw[s:e].decode("utf-8", "replace") for s, e in at_words]

    known = encoder.numbers(hashes, spell)
    pieces = encoder.length[known]
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    flat = encoder.tokens[np.repeat(encoder.first[known], pieces) + place]
    fallen = np.concatenate([[0], np.cumsum(encoder.is_fallback[flat])])
    ends = np.cumsum(pieces)
    fallback = fallen[ends] - fallen[ends - pieces]
    in_bytes = encoder.in_bytes[known]

    def total(per_word: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=per_word[number], minlength=docs).astype(np.int64) if len(doc) else np.zeros(docs, np.int64)

    n_tokens, n_fallback, n_bytes = total(pieces), total(fallback), total(in_bytes)
    chars = np.array([len(t) - sum(t.count(c) for c in BLANKS) for t in texts], np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = {
            "chars_per_token": np.where(n_tokens > 0, chars / n_tokens, np.nan),
            "chars_per_byte_token": np.where(n_bytes > 0, chars / n_bytes, np.nan),
            "fallback_share": np.where(n_tokens > 0, n_fallback / n_tokens, np.nan),
        }
    out["entropy_ratio"] = _entropy_ratio(doc, number, flat, pieces, n_tokens, docs)
    lines = [[x for x in t.split("\n") if x.strip(BLANKS)] if "\n" in t else () for t in texts]
    return out | {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": np.array([sum(t.count(c) for c in SYMBOLS) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeated_window_words(number, doc, docs),
        "n_tokens": n_tokens,
        "length_class": np.floor(np.log2(np.maximum(n_tokens, 1))).astype(np.int32),
    }


def _entropy_ratio(doc, number, flat, pieces, n_tokens, docs) -> np.ndarray:
    """Shannon entropy of each document's tokens over the largest it could have at that length."""
    if not len(doc):
        return np.full(docs, np.nan)
    begin = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    take = pieces[number]
    place = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    token = flat[np.repeat(begin[number], take) + place].astype(np.int64)
    key = np.sort(np.repeat(doc, take) * (1 << 20) + token)
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(cuts, len(key)))
    owner = key[cuts] >> 20
    share = count / n_tokens[owner]
    entropy = np.bincount(owner, weights=-share * np.log2(share), minlength=docs)
    return np.where(n_tokens > 1, entropy / np.log2(np.maximum(n_tokens, 2)), np.where(n_tokens == 1, 0.0, np.nan))


def measure(
    docs: DataFrame, folder: str | None = None, piece_file: str = PIECE_VOCABULARY, byte_file: str = BYTE_VOCABULARY
) -> DataFrame:
    """Counts and fertility figures of every document. ``folder`` holds the vocabulary files on every machine."""
    place = folder or vocabulary_folder()

    def run(batches):
        encoder = _encoder(place, piece_file, byte_file)
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                ids, langs = batch.column("doc_id")[first:last], batch.column("lang")[first:last].to_pylist()
                texts = [t or "" for t in batch.column("text")[first:last].to_pylist()]
                found = measure_block(texts, data, at, encoder)
                group = [g if g else "script:" + script_of(t) for g, t in zip(langs, texts, strict=True)]
                columns = [ids, pa.array(group, pa.string()), pa.array(found.pop("length_class"), pa.int32())]
                names = [c.split()[0] for c in SCHEMA.split(", ")][3:]
                for name in names:
                    floats = found[name].dtype.kind == "f"
                    columns.append(pa.array(found[name], pa.float64() if floats else pa.int64(), mask=np.isnan(found[name]) if floats else None))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "band_group", "length_class", *names])

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.trim("lang").alias("lang")
    )
    return narrow.mapInArrow(run, SCHEMA)


def bands(measured: DataFrame, spread: float = 5.0, floor: float = 5.0) -> DataFrame:
    """Per language or script and length class (-1: all of the group), middle and reach of each metric and the documents they are from.

    The reach is ``spread`` robust deviations (at least ``floor`` histogram steps), over the documents that pass the base rule. The
    histograms are bounded: metrics are counted in fixed steps, so no class is sorted in one task.
    """
    usable = measured.filter(~F.col("base_failed"))
    steps = F.explode(
        F.array(*(F.struct(F.lit(m).alias("metric"), F.floor(F.col(m) / w).alias("step")) for m, w in METRICS.items()))
    )
    counted = (
        usable.select("band_group", "length_class", steps.alias("x"))
        .select("band_group", "length_class", "x.metric", "x.step")
        .filter("step IS NOT NULL")
        .groupBy("band_group", "length_class", "metric", "step")
        .agg(F.count("*").alias("n"))
    )
    both = counted.unionByName(
        counted.groupBy("band_group", "metric", "step").agg(F.sum("n").alias("n")).withColumn("length_class", F.lit(-1))
    )
    cell = Window.partitionBy("band_group", "length_class", "metric")
    below = F.sum("n").over(cell.orderBy("step"))
    placed = both.withColumn("below", below).withColumn("total", F.sum("n").over(cell))

    def quantile(q: float):
        return F.min(F.when(F.col("below") >= F.col("total") * q, F.col("step")))

    cuts = placed.groupBy("band_group", "length_class", "metric").agg(
        quantile(0.25).alias("q1"), quantile(0.5).alias("mid"), quantile(0.75).alias("q3"), F.max("total").alias("total")
    )
    width = F.create_map(*(F.lit(v) for pair in METRICS.items() for v in pair))[F.col("metric")]
    reach = F.greatest(F.lit(floor), (F.col("q3") - F.col("q1")) / F.lit(1.349) * spread)
    return cuts.select(
        "band_group", "length_class", "metric", "total",
        ((F.col("mid") + 0.5) * width).alias("mid"), (reach * width).alias("reach"),
    )


def judge(docs: DataFrame, prior: float = PRIOR_DOCUMENTS, **vocabulary) -> DataFrame:
    """One row per document: counts, fertility figures, ``base_failed`` and ``kept``.

    A class of n documents has the band n / (n + prior) of the way from its group's to its own, in middle and in reach; the group's
    reach is widened for short texts as sampling error widens. There is no class size at which the rule changes.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = materialise(measure(docs, **vocabulary).withColumn("base_failed", base), "fertility")
    limits = bands(measured)
    wide = limits.groupBy("band_group", "length_class").pivot("metric", list(METRICS)).agg(
        F.struct(F.first("mid").alias("mid"), F.first("reach").alias("reach"), F.first("total").alias("total"))
    )
    own = wide.select("band_group", "length_class", *(F.col(m).alias(f"own_{m}") for m in METRICS))
    whole = wide.filter("length_class = -1").select("band_group", *(F.col(m).alias(f"all_{m}") for m in METRICS))
    joined = measured.join(own, ["band_group", "length_class"], "left").join(whole, "band_group", "left")
    wider = F.sqrt(F.greatest(F.lit(1.0), F.lit(FULL_BAND_TOKENS) / F.greatest(F.col("n_tokens"), F.lit(1))))
    outside = []
    for m in METRICS:
        n = F.coalesce(F.col(f"own_{m}.total"), F.lit(0))
        own_share = n / (n + prior)

        def between(own, group):
            return own_share * F.coalesce(own, F.lit(0.0)) + (1 - own_share) * group

        mid = between(F.col(f"own_{m}.mid"), F.col(f"all_{m}.mid"))
        reach = between(F.col(f"own_{m}.reach"), F.col(f"all_{m}.reach") * wider)
        outside.append(
            F.when(F.col(m) < mid - reach, F.lit(f"{m} low")).when(F.col(m) > mid + reach, F.lit(f"{m} high"))
        )
    reasons = F.array_compact(F.array(*outside))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(reasons) == 0)).alias("kept"),
        "band_group", "length_class", "n_tokens", *METRICS, F.array_join(reasons, ", ").alias("out_of_band"),
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; rows of one doc_id and text are judged alike."""
    verdict = judge(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text", "lang"))
    rejected = verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(rejected, F.xxhash64(docs["doc_id"], docs["text"]) == rejected["_key"], "left_anti")
