"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. The automaton holds every run of
words that occurs in an item. Document words stream through it; at each word it tells the longest run ending there that is also
in an item, and suffix links lead from that run to its shorter endings. An item of n words is found where a run of
least(``length``, ceil(``coverage`` * n)) of its words occurs: that many words in a row, or that share of a short item. The automaton's
states are marked with the items they stand for at just these run lengths, so one look at a state tells all items found.

Items are dealt into blocks whose words are counted and bounded (``block_words``; longer items are cut into pieces that overlap by
``length`` - 1 words, which loses no run of ``length`` words). A block is broadcast, each worker builds its automaton once, and all
documents pass it; with several blocks the documents carry what was found from pass to pass. Before streaming, numpy cuts texts where a
word, or a pair of neighbouring words, is in no item of the block (by 64-bit hashes, which can only err towards looking): runs too short
for any item are skipped, the rest is compared word by word.

A text is worked on in segments of ``SEGMENT`` bytes cut between words, with the automaton's state carried over, so memory follows the
segment (or a single longer word), not the text.

Defined results: a NULL or empty text, or one without word characters, has no words and is clean. Items without words, or
whose text is NULL, are never found. Rows of one item_id are one item; a NULL item_id is spelled as the empty string. Repeated document
rows count each. An empty benchmark leaves every document clean. Columns other than the ones named are ignored by ``find`` and kept by
``remove``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoptrace.llm.shared import blocks, prefix_sums, span_hashes
from shoptrace.sources.tables import materialise, release, written

LENGTH, COVERAGE = 10, 1.0
#: Words of one automaton: some 80 MB in a worker.
BLOCK_WORDS = 200_000
#: An item longer than this is cut into overlapping pieces.
PIECE_WORDS = 4_096
SEGMENT = 1 << 22
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_INSIDE = np.array([bool(WORD.match(_LOWER[b : b + 1])) for b in range(256)])
FOUND = "n_words long, longest long, items array<string>, spans array<struct<first_word:long,end_word:long,first_byte:long,end_byte:long>>"


class Automaton:
    """Suffix automaton of several word sequences, its states marked with the items found there.

    ``pieces`` are (item, threshold, words). State 0 is the empty run; ``length[s]`` is the longest run of a state,
    ``link[s]`` the state of its longest ending that occurs elsewhere too.
    """

    def __init__(self, pieces: Sequence[tuple[str, int, list[bytes]]]):
        self.number: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.least = min((t for _, t, _ in pieces), default=1)
        coded = [(item, t, [self.number.setdefault(w, len(self.number)) for w in words]) for item, t, words in pieces]
        for _, _, words in coded:
            state = 0
            for w in words:
                state = self._add(state, w)
        #: State -> threshold -> items with a run of so many words that ends here.
        self.marks: dict[int, dict[int, list[str]]] = {}
        for item, t, words in coded:
            state = run = 0
            for w in words:
                state, run = self.step(state, run, w)
                if run >= t:
                    end = state
                    while self.length[self.link[end]] >= t:
                        end = self.link[end]
                    items = self.marks.setdefault(end, {}).setdefault(t, [])
                    if not items or items[-1] != item:
                        items.append(item)
        #: The nearest marked state at or above each one, or 0.
        self.marked = [0] * len(self.go)
        for state in sorted(range(1, len(self.go)), key=self.length.__getitem__):
            self.marked[state] = state if state in self.marks else self.marked[self.link[state]]
        self.words = np.sort(word_hashes(list(self.number)))
        pairs = {(a, b) for _, _, words in pieces for a, b in zip(words, words[1:], strict=False)}
        first, second = (word_hashes([p[i] for p in pairs]) for i in (0, 1))
        self.pairs = np.sort(pair_hashes(first, second))

    def _add(self, last: int, word: int) -> int:
        """The state of the run ``last`` + ``word`` of an item that is being read in."""
        there = self.go[last].get(word)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there  # another item began alike
        new = None
        if there is None:
            new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.go[p]:
            self.go[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
            return new
        q = self.go[p][word]
        if self.length[q] != self.length[p] + 1:
            copy = self._state(dict(self.go[q]), self.length[p] + 1)
            self.link[copy] = self.link[q]
            self.link[q] = copy
            while p >= 0 and self.go[p].get(word) == q:
                self.go[p][word] = copy
                p = self.link[p]
            q = copy
        if new is None:
            return q
        self.link[new] = q
        return new

    def _state(self, go: dict[int, int], length: int) -> int:
        self.go.append(go)
        self.link.append(0)
        self.length.append(length)
        return len(self.go) - 1

    def step(self, state: int, run: int, word: int) -> tuple[int, int]:
        """State and length of the longest run after one more word."""
        go, link = self.go, self.link
        while state and word not in go[state]:
            state = link[state]
            run = self.length[state]
        if word in go[state]:
            return go[state][word], run + 1
        return 0, 0

    def ends(self, state: int, run: int) -> Iterator[tuple[int, int]]:
        """(marked state, threshold) of everything found that ends with this run."""
        state = self.marked[state]
        while state:
            for threshold in self.marks[state]:
                if threshold <= run:
                    yield state, threshold
            state = self.marked[self.link[state]]


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words], dtype=np.int64)
    start = end - np.array([len(w) for w in words], np.int64)
    return span_hashes(prefix_sums(data, lower=True), start, end)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first * np.uint64(0x9E3779B97F4A7C15) + second


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    place = np.searchsorted(known, values)
    place[place == len(known)] = 0
    return known[place] == values


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(_INSIDE[data].view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


class Reader:
    """Streams the words of one document through an automaton, segment by segment."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.state, self.run = automaton, 0, 0
        self.n_words, self.longest = 0, 0
        self.ends: set[tuple[int, int]] = set()
        self.spans: list[list[int]] = []
        self.starts: dict[int, int] = {}

    def stream(self, words: Sequence[bytes], first: int, begins: Sequence[int], stops: Sequence[int]) -> None:
        """``words`` stand at word numbers from ``first`` on, and at these bytes; the state before them is ``self.state``."""
        a, state, run = self.automaton, self.state, self.run
        number, marked, least = a.number, a.marked, a.least
        for k, word in enumerate(words):
            code = number.get(word, -1)
            state, run = a.step(state, run, code) if code >= 0 else (0, 0)
            if run < least:
                continue
            self.longest = max(self.longest, run)
            if not marked[state]:
                continue
            reach = 0
            for end in a.ends(state, run):
                self.ends.add(end)
                reach = max(reach, end[1])
            if reach:
                self._hit(first + k + 1 - reach, first + k + 1, begins, stops[k], first)
        self.state, self.run = state, run

    def _hit(self, start: int, end: int, begins: Sequence[int], stop: int, first: int) -> None:
        if self.spans and start <= self.spans[-1][1]:
            last = self.spans[-1]
            if start < last[0]:
                last[0], last[2] = start, self._byte(start, begins, first)
            last[1], last[3] = end, stop
            while len(self.spans) > 1 and self.spans[-2][1] >= last[0]:
                before = self.spans.pop(-2)
                if before[0] < last[0]:
                    last[0], last[2] = before[0], before[2]
        else:
            self.spans.append([start, end, self._byte(start, begins, first), stop])

    def _byte(self, word: int, begins: Sequence[int], first: int) -> int:
        return begins[word - first] if word >= first else self.starts[word]

    def carry(self, end: int, begins: Sequence[int]) -> None:
        """Keep where the last words before word ``end`` begin: a run may go on in the next segment."""
        kept = {n: b for n, b in self.starts.items() if n >= end - self.run}
        self.starts = kept | {end - i: begins[-i] for i in range(1, min(len(begins), self.run) + 1)}

    def reset(self) -> None:
        self.state = self.run = 0

    def items(self) -> set[str]:
        marks = self.automaton.marks
        return {item for state, threshold in self.ends for item in marks[state][threshold]}


def segments(data: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first byte, bytes) of about ``size`` bytes each, cut where no word is cut; a longer word stays whole."""
    first = 0
    while first < len(data):
        last = min(first + size, len(data))
        while last < len(data) and _INSIDE[data[last]] and _INSIDE[data[last - 1]]:
            gap = np.flatnonzero(~_INSIDE[data[last : last + size]])
            last = last + int(gap[0]) if len(gap) else min(last + size, len(data))
        yield first, data[first:last]
        first = last


def read_block(data: np.ndarray, at: np.ndarray, automaton: Automaton, readers: Sequence[Reader], offset: int = 0, cut: bool = False) -> None:
    """Let each document of a block (bytes ``data``, rows at ``at``) stream; ``cut``: it is one segment of one document."""
    begin, end = word_spans(data) if len(at) == 2 else _spans_by_row(data, at)
    doc = np.searchsorted(at, begin, "right") - 1
    counts = np.bincount(doc, minlength=len(readers))
    h = span_hashes(prefix_sums(data, lower=True), begin, end)
    known = among(h, automaton.words)
    linked = np.zeros(len(h), bool)  # with the word before
    if len(h) > 1:
        linked[1:] = (doc[1:] == doc[:-1]) & known[1:] & known[:-1] & among(pair_hashes(h[:-1], h[1:]), automaton.pairs)
    start = np.flatnonzero(known & ~linked)
    stop = np.append(start[1:], len(h))
    if len(start):  # a run ends with its last linked word
        unknown = np.append(np.flatnonzero(~known), len(h))
        stop = np.minimum(stop, unknown[np.searchsorted(unknown, start)])
    long = stop - start >= automaton.least
    if cut and len(h):  # runs at the edges of a segment may go on
        long |= (start == 0) | (stop == len(h))
        if not known[0]:
            readers[0].reset()
    first_word = np.searchsorted(doc, np.arange(len(readers)), "left")
    lowered = data.tobytes().translate(_LOWER)
    last_end = 0
    for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True):
        reader = readers[doc[a]]
        if not (cut and a == 0):
            reader.reset()
        begins, stops = begin[a:b].tolist(), end[a:b].tolist()
        words = [lowered[x:y] for x, y in zip(begins, stops, strict=True)]
        first, shift = reader.n_words + a - int(first_word[doc[a]]), offset - int(at[doc[a]])
        begins, stops = [x + shift for x in begins], [y + shift for y in stops]
        reader.stream(words, first, begins, stops)
        if cut:
            reader.carry(first + b - a, begins)
        last_end = b
    if cut and len(h) and last_end < len(h):
        readers[0].reset()
    for reader, n in zip(readers, counts.tolist(), strict=True):
        reader.n_words += n


def _spans_by_row(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _INSIDE[data]
    opens, closes = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    opens[1:-1], closes[1:-1] = ~inside[:-1], ~inside[1:]
    opens[at], closes[at] = True, True  # a word ends with its document
    return np.flatnonzero(inside & opens[:-1]), np.flatnonzero(inside & closes[1:]) + 1


def matches(column: pa.Array, automaton: Automaton) -> Iterator[tuple[int, int, list[Reader]]]:
    """(first row, row after the last, a reader that has seen each row)."""
    for first, last, data, at in blocks(column):
        readers = [Reader(automaton) for _ in range(last - first)]
        if len(data) <= SEGMENT:
            read_block(data, at, automaton, readers)
        else:  # one long document
            for offset, part in segments(data, SEGMENT):
                read_block(part, np.array([0, len(part)]), automaton, readers, offset, cut=True)
        yield first, last, readers


_built: dict[str, Automaton] = {}


def _automaton(key: str, pieces) -> Automaton:
    """Built once in a worker; only the last one is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton([(item, t, text.encode().split(b" ")) for item, t, text in pieces])
    return _built[key]


def item_pieces(benchmark: DataFrame, length: int = LENGTH, coverage: float = COVERAGE) -> DataFrame:
    """(item, threshold, words): normalised items, long ones in overlapping pieces."""
    if length < 1 or not 0 < coverage <= 1 or length > PIECE_WORDS // 2:
        raise ValueError("length must lie in 1..2048 words and coverage in (0, 1]")
    lowered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("all")).where(F.size("all") > 0)
    threshold = F.least(F.lit(length), F.ceil(F.size("all") * F.lit(float(coverage))).cast("int"))
    step = PIECE_WORDS - length + 1
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (length - 1)), F.lit(step))
    cut = items.select("item", threshold.alias("threshold"), "all", F.explode(starts).alias("at"))
    return cut.select("item", "threshold", F.slice("all", F.col("at"), PIECE_WORDS).alias("words")).distinct()


def item_blocks(benchmark: DataFrame, length: int, coverage: float, block_words: int) -> tuple[DataFrame, list[int]]:
    """The pieces as (block, item, threshold, text), and the numbers of the blocks, none with more than ``block_words`` words."""
    joined = item_pieces(benchmark, length, coverage).select("item", "threshold", F.size("words").alias("n"), F.array_join("words", " ").alias("text"))
    pieces = materialise(joined, "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // block_words))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "threshold", "text"), F.lit(count)))
        sizes = dealt.groupBy("block").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pieces"))
        over = sizes.where((F.col("n") > block_words) & (F.col("pieces") > 1)).limit(1).count()
        if not over:
            return dealt, sorted(r.block for r in sizes.select("block").collect())
        count *= 2


def found_in(docs: DataFrame, pieces: DataFrame, block: int, keep_text: bool) -> DataFrame:
    """``docs`` with the columns of ``FOUND``, what earlier blocks found included, after the items of one more block."""
    own = pieces.where(F.col("block") == block).select("item", "threshold", "text").collect()  # bounded by item_blocks
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own])
    key = uuid.uuid4().hex
    kept = ["row", "text"] if keep_text else ["row"]

    def run(batches):
        for batch in batches:
            automaton = _automaton(key, sent.value)
            earlier = batch.select(["longest", "items", "spans"]).to_pylist()
            out = []
            for first, _, readers in matches(batch.column("text"), automaton):
                for old, r in zip(earlier[first:], readers, strict=False):
                    spans = merged([*(tuple(s.values()) for s in old["spans"]), *map(tuple, r.spans)])
                    out.append((r.n_words, max(r.longest, old["longest"]), sorted(r.items() | set(old["items"])), spans))
            names = ("first_word", "end_word", "first_byte", "end_byte")
            rows = [{"n_words": n, "longest": m, "items": i, "spans": [dict(zip(names, s, strict=True)) for s in p]} for n, m, i, p in out]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(kept).columns, *pa.RecordBatch.from_pylist(rows, _FOUND).columns], names=[*kept, *_FOUND.names]
            )

    schema = T.StructType([*(docs.schema[c] for c in kept), *T.StructType.fromDDL(FOUND)])
    return docs.select("row", "text", "longest", "items", "spans").mapInArrow(run, schema)


_SPAN = pa.struct([(n, pa.int64()) for n in ("first_word", "end_word", "first_byte", "end_byte")])
_FOUND = pa.schema([("n_words", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])


def merged(spans: Sequence[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of words that touch or overlap become one."""
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2], s[3])
        else:
            out.append(tuple(s))
    return out


def matched(rows: DataFrame, benchmark: DataFrame, length: int, coverage: float, block_words: int, keep_text: bool = False) -> DataFrame:
    """``rows`` (row, and text if it is to be kept) with the columns of ``FOUND``, after all items."""
    spark = rows.sparkSession
    pieces, numbers = item_blocks(benchmark, length, coverage, block_words)
    table, path = rows.select("row", "text", *nothing_found()), None
    for i, block in enumerate(numbers or [0]):
        more = i + 1 < len(numbers)
        table = found_in(table, pieces, block, keep_text or more)
        if more:
            table, new = written(table, "matched")
            if path:
                release(spark, path)
            path = new
    return table


def nothing_found() -> list[Column]:
    spans = FOUND.split("spans ")[1]
    return [F.lit(0).cast("long").alias("longest"), F.array().cast("array<string>").alias("items"), F.array().cast(spans).alias("spans")]


def find(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words in spans), longest (match of some item's least run or more), items, spans.

    Spans are (first_word, end_word, first_byte, end_byte), ends exclusive, bytes of the UTF-8 text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["first_word"])
    return matched(rows, benchmark, length, coverage, block_words).select(
        F.col("row").alias("doc_id"), "n_words", hit.alias("n_hit"), "longest", "items", "spans"
    )


def remove(
    docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, coverage: float = COVERAGE, most_hit: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` without the found spans; documents of whose words more than the share ``most_hit`` is found go altogether.

    A cut text keeps everything outside the spans, with one space where a span stood between two words. All columns stay.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = matched(rows, benchmark, length, coverage, block_words, keep_text=True)
    raw = F.col("text").cast("binary")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.substring(
            raw,
            F.when(i == 0, F.lit(1)).otherwise(F.get("spans", (i - 1).cast("int"))["end_byte"].cast("int") + 1),
            F.coalesce(F.get("spans", i.cast("int"))["first_byte"].cast("int"), F.octet_length("text"))
            - F.when(i == 0, F.lit(0)).otherwise(F.get("spans", (i - 1).cast("int"))["end_byte"].cast("int")),
        ).cast("string"),
    )
    text = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(F.array_join(pieces, " "))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["first_word"])
    kept = found.where(hit <= F.col("n_words") * F.lit(float(most_hit)))
    return kept.select(F.col("row").alias("_row"), text.alias("_text")).select(
        *(F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns)
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    found = find(docs, benchmark, **settings)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    docs AS MATERIALIZED (SELECT * FROM w),
    items AS (SELECT CAST(item_id AS VARCHAR) AS item,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
    sized AS (SELECT item, words, least(10, len(words)) AS t FROM items WHERE len(words) > 0),
    windows AS MATERIALIZED (SELECT DISTINCT item, t, words[i : i + t - 1] AS x
        FROM (SELECT *, unnest(range(1, len(words) - t + 2)) AS i FROM sized)),
    lengths AS (SELECT DISTINCT t FROM windows),
    places AS MATERIALIZED (SELECT r, i, t, words[i : i + t - 1] AS x
        FROM (SELECT r, words, t, unnest(range(1, len(words) - t + 2)) AS i FROM docs, lengths WHERE len(words) >= t)),
    hits AS MATERIALIZED (SELECT r, i, t, item FROM places JOIN windows USING (t, x)),
    covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + t)) AS k FROM (SELECT DISTINCT r, i, t FROM hits)) GROUP BY r),
    named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""
