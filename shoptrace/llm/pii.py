"""Personal data and terms that give it away.

Base spans (e-mail, IP, card, phone) come from patterns and number checks. The method adds terms: over all lines of the
corpus it counts how often a term stands in a line with a protected entity, and takes as disclosure the pointwise mutual
information of term and entity divided by the information content of the entity,

    log2(n(e, t) N / (n(e) n(t))) / log2(N / n(e)),

which is 1 when the term never occurs without the entity. Terms are runs of letters and digits of any length outside base spans; a line of more
than ``LINE_CHARS`` characters counts as several, cut between words, so the pairs of a text grow with its length only. A term seen with an entity in at least ``SUPPORT`` different
lines whose disclosure reaches ``GENERALISE`` is generalised in the documents where both stand in one line; from ``REMOVE`` on
it is removed. Different lines are told apart by hash, so copies of a document are no evidence.

Everything here is DataFrame operations. Counts are aggregated in the scan tasks before any shuffle, so an entity or a term of
a third of all lines is no hot key. Only documents with base spans carry their text beyond the scan.

Defined results: a NULL text is empty and has no spans. Repeated rows get the same spans each. A NULL doc_id is kept as NULL.
Base spans may overlap between kinds; masking joins what overlaps. Term spans that touch a base span are left out. Extra
columns are ignored by ``find_spans`` and passed through by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptrace.llm.shared import id_and_text
from shoptrace.sources.tables import materialise

SUPPORT = 3
GENERALISE = 0.85
REMOVE = 0.97
#: Longer lines are cut.
LINE_CHARS = 1000

#: A match can begin only where its run begins or where the last match ended; possessive repeats keep long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
RUN = r"\p{L}\p{M}\p{N}"
LINE = rf"[^\n]{{1,{LINE_CHARS}}}(?!\S)|\S+"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def spans_of(text: Column, pattern: Column | str, kind: str) -> Column:
    """Spans of all matches in code points: the lengths of matches and of the pieces between them, summed up."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, start, step, lambda state: state["out"])


def base_spans(text: Column) -> Column:
    """All base spans by kind, then start. Texts without the characters a kind needs skip its pattern."""
    none = F.array().cast(SPAN)
    email = F.when(F.contains(text, F.lit("@")), spans_of(text, EMAIL, "email")).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), spans_of(text, IP, "ip")).otherwise(none)
    ip = F.filter(ip, lambda s: s["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), spans_of(text, CARD, "card")).otherwise(none)
    card = F.filter(card, lambda s: F.length(_digits(s["value"])).between(13, 19))
    card = F.filter(card, lambda s: _luhn(_digits(s["value"])))
    phone = F.when(text.rlike(r"\+[0-9]"), spans_of(text, PHONE, "phone")).otherwise(none)
    phone = F.filter(phone, lambda s: F.length(_digits(s["value"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def entity(span: Column) -> Column:
    """What counts as the same protected entity: kind and value without case and separators."""
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def _lines(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(LINE), F.lit(0)), lambda x: F.trim(x) != "")


def _terms(line: Column, base: Column) -> Column:
    """Different runs of letters and digits outside the base spans of the line."""
    free = masked(line, F.transform(base, lambda s: s.withField("kind", F.lit("blank"))))
    return F.array_distinct(F.regexp_extract_all(F.lower(free), F.lit(f"[{RUN}]+"), F.lit(0)))


def disclosures(docs: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Disclosing (entity, term, action) and the places (doc_id, text_hash, entity, term) where both stand in a line.

    ``docs(doc_id, text)`` are all documents, ``marked(doc_id, text_hash, text, base)`` those with base spans.
    """
    lines = marked.select("doc_id", "text_hash", F.explode(_lines(F.col("text"))).alias("line"))
    based = lines.select("doc_id", "text_hash", "line", base_spans(F.col("line")).alias("spans")).filter(F.size("spans") > 0)
    held = based.select(
        "doc_id", "text_hash", F.xxhash64("line").alias("context"), F.array_distinct(F.transform("spans", entity)).alias("entities"),
        _terms(F.col("line"), F.col("spans")).alias("terms"),
    )
    held = materialise(held, "entity_lines")
    totals = docs.select(F.sum(F.size(_lines(F.col("text")))).alias("lines"))
    seen = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    places = held.select("doc_id", "text_hash", "context", F.explode("entities").alias("entity"), "terms").select(
        "doc_id", "text_hash", "context", "entity", F.explode("terms").alias("term")
    )
    joint = places.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(
        F.sum("n").alias("n_joint"), F.count("*").alias("n_contexts")
    )
    joint = materialise(joint.filter(F.col("n_contexts") >= SUPPORT), "joint")
    wanted = joint.select("term").distinct()
    every = docs.select(F.explode(_lines(F.col("text"))).alias("line"))
    words = every.select(F.explode(_terms(F.col("line"), base_spans(F.col("line")))).alias("term"))
    counted = words.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term")
    joined = joint.join(counted, "term").join(seen, "entity").withColumn("lines", totals.scalar())
    information = F.log2(F.col("lines") / F.col("n_entity"))
    mutual = F.log2(F.col("n_joint") * F.col("lines") / (F.col("n_entity") * F.col("n_term")))
    scored = joined.withColumn("disclosure", mutual / information).filter(F.col("disclosure") >= GENERALISE)
    action = F.when(F.col("disclosure") >= REMOVE, F.lit("remove")).otherwise(F.lit("generalise"))
    flagged = scored.select("entity", "term", "disclosure", action.alias("action"))
    return flagged, places.select("doc_id", "text_hash", "entity", "term").distinct()


def term_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, terms): spans of disclosing terms, for the documents that have any."""
    narrow = id_and_text(docs)
    suspect = narrow.filter(F.contains("text", F.lit("@")) | F.col("text").rlike(r"[0-9]\.[0-9]|[0-9](?:[\x20-]?[0-9]){8}|\+[0-9]"))
    marked = suspect.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", base_spans(F.col("text")).alias("base"))
    marked = materialise(marked.filter(F.size("base") > 0), "marked")
    flagged, places = disclosures(narrow, marked)
    of_doc = places.join(flagged, ["entity", "term"]).groupBy("doc_id", "text_hash", "term").agg(F.min("action").alias("action"))
    lists = of_doc.groupBy("doc_id", "text_hash").agg(
        *(
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("action") == a, F.col("term")))), "|").alias(a)
            for a in ("generalise", "remove")
        )
    )
    texts = marked.dropDuplicates(["doc_id", "text_hash"])
    lists = lists.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    found = texts.join(lists, F.expr("doc_id <=> _id AND text_hash = _hash"))
    none = F.array().cast(SPAN)

    def located(name: str) -> Column:
        pattern = F.concat(F.lit(rf"(?<![{RUN}])(?iu:"), F.col(name), F.lit(rf")(?![{RUN}])"))
        return F.when(F.col(name) != "", spans_of(F.col("text"), pattern, name)).otherwise(none)

    free = F.filter(
        F.concat(located("generalise"), located("remove")),
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return found.select("doc_id", "text_hash", free.alias("terms")).filter(F.size("terms") > 0)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _joined_terms(table: DataFrame, found: DataFrame) -> DataFrame:
    side = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("terms").alias("_terms"))
    return table.join(side, F.expr("doc_id <=> _id AND _text_hash = _hash"), "left").withColumn(
        "_terms", F.coalesce("_terms", F.array().cast(SPAN))
    )


def find_spans(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans as ``kind:start:end`` by kind, then start."""
    base = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("_text_hash"), base_spans(F.col("text")).alias("base"))
    base = materialise(base, "base_spans")
    both = _joined_terms(base, materialise(term_spans(docs), "term_spans"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return both.select(
        "doc_id", *(count(k) for k in ("email", "ip", "card", "phone")),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "_terms")).alias("spans"), F.size("_terms").cast("long").alias("n_terms"),
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its mask; spans that overlap share the first one's."""
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        mask = F.when(s["kind"] == "remove", F.lit("")).when(s["kind"] == "blank", F.lit(" ")).when(s["kind"] == "generalise", F.lit("[TERM]"))
        mask = mask.otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], kept, mask)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    rest = F.aggregate(
        ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span masked in ``text`` and ``n_chars`` brought up to date; other columns stay."""
    found = materialise(term_spans(docs), "term_spans")
    # the rows travel as one struct, so none of their columns can clash with those of the work
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashed.alias("_text_hash"), F.struct("*").alias("_doc"))
    text = F.col("_doc.text")
    clean = _joined_terms(rows, found).select("_doc", masked(text, F.concat(base_spans(text), "_terms")).alias("_clean"))
    columns = {c: F.col("_doc").getField(c) for c in docs.columns} | {"text": F.col("_clean")}
    if "n_chars" in columns:
        length = F.when(F.col("_clean").isNull(), columns["n_chars"]).otherwise(F.length("_clean"))
        columns["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return clean.select(*(value.alias(c) for c, value in columns.items()))
