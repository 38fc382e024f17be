"""Quality and toxicity of documents by hierarchical empirical Bayes.

*Evidence.* Labelled documents, at most ``MAX_LABELLED`` rows by hash of doc_id, give per feature how many bad and good ones
have it. A feature is a word, a word's last three bytes, or a step of the share of distinct words; features are hashed to
``FEATURES`` slots, so the model has a fixed size. Those whose log odds differ from zero by ``LEAST_Z`` standard errors count; the
sum over a document, scaled by one slope, is its log likelihood ratio. The slope is fitted on every fourth document, scored with counts of the others.

*Sites.* Every document's probability under the global prior is summed by host (source) and by path (source and language). A
host's rate is drawn to the global rate, a path's to its host's, with as many pseudo-documents as the spread between
sites shows (method of moments): sparse sites lean on their parents. These are grouped sums; a host of a third of all
documents is combined in the scan tasks.

*Posterior.* Likelihood ratio times the path's prior odds. A document is kept when neither low quality nor toxicity is likelier
than not.

Defined results: a text without words has no evidence and takes its path's prior. NULL sources or languages are sites of their
own. Repeated rows are judged each and counted each. Without labels, or with one class only, there is no evidence and every
document gets the global prior of one half and is kept. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptrace.llm.shared import U, blocks, distinct_per_document, id_and_text, mix, prefix_sums, span_hashes, words_of
from shoptrace.sources.tables import materialise

#: The most labelled documents the classifier is fitted on.
MAX_LABELLED = 20_000
FEATURES = 1 << 18
LEAST_Z = 4.0
LEAST_DOCUMENTS = 5
#: Where no slope can be fitted: features overlap, so their log odds are not added up in full.
FEW_LABELS_SLOPE = 0.5
TARGETS = ("low", "toxic")


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature slot, document), distinct per document."""
    start, end, doc = words_of(data, at)
    word = span_hashes(prefix_sums(data, lower=True), start, end)
    tail = mix(span_hashes(prefix_sums(data), np.maximum(start, end - 3), end) ^ U(0x5851F42D4C957F2D))
    own, owner = distinct_per_document(word, doc)
    docs = len(at) - 1
    total, different = np.bincount(doc, minlength=docs), np.bincount(owner, minlength=docs)
    step = (10 * different // np.maximum(total, 1)).astype(U)
    some = np.flatnonzero(total > 0)
    slots = np.concatenate([own, tail, mix(step[some] + U(0x2545F4914F6CDD1D))]) % U(FEATURES)
    return distinct_per_document(slots, np.concatenate([owner, doc, some]))


def _counts(batches):
    """Per feature slot how many labelled documents of each class have it; slot -1 counts the documents."""
    for batch in batches:
        labels = np.stack([batch.column(t).to_numpy(False) for t in TARGETS], axis=1)
        for first, last, data, at in blocks(batch.column("text")):
            slot, owner = features(data, at)
            for k in range(len(TARGETS)):
                bad = labels[first:last, k].astype(bool)
                here = np.bincount(slot.astype(np.int64), weights=bad[owner], minlength=FEATURES)
                every = np.bincount(slot.astype(np.int64), minlength=FEATURES)
                some = np.flatnonzero(every)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some) + 1, k, np.int32)), pa.array(np.append(some, -1)),
                        pa.array(np.append(here[some], bad.sum()).astype(np.int64)), pa.array(np.append(every[some], len(bad)).astype(np.int64)),
                    ],
                    names=["target", "slot", "bad", "n"],
                )


class Model:
    """Log odds of each feature slot for both targets, their slopes and the sample's prior log odds."""

    def __init__(self):
        self.weights = np.zeros((len(TARGETS), FEATURES), np.float32)
        self.slope, self.prior = np.zeros(len(TARGETS)), np.zeros(len(TARGETS))

    def sums(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        slot, owner = features(data, at)
        return np.stack([np.bincount(owner, weights=w[slot.astype(np.int64)], minlength=len(at) - 1) for w in self.weights])


def _weights(bad: np.ndarray, n: np.ndarray, bad_docs: int, docs: int) -> np.ndarray:
    good, good_docs = n - bad, docs - bad_docs
    odds = np.log((bad + 0.5) / (bad_docs - bad + 0.5)) - np.log((good + 0.5) / (good_docs - good + 0.5))
    error = np.sqrt(1 / (bad + 0.5) + 1 / (bad_docs - bad + 0.5) + 1 / (good + 0.5) + 1 / (good_docs - good + 0.5))
    return np.where((np.abs(odds) >= LEAST_Z * error) & (n >= LEAST_DOCUMENTS), odds, 0.0)


def _fit_slope(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic regression by Newton steps, drawn slightly to zero."""
    beta = np.zeros(2)
    x = np.stack([score, np.ones_like(score)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (label - p) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Texts of at most ``most`` labelled documents, one for each doc_id: of several rows the one with the least text hash.

    Their ids, being so few, are broadcast. Every fourth document is marked ``held``: the slope is fitted on those.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("low"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = id_and_text(docs).join(F.broadcast(some), "doc_id")
    one = found.groupBy("doc_id", "low", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return one.select("low", "toxic", (F.pmod(F.xxhash64(F.lit("held"), F.col("doc_id")), F.lit(4)) == 0).alias("held"), "least.text")


def _weighted(sample: DataFrame) -> Model:
    counted = sample.mapInArrow(_counts, "target int, slot long, bad long, n long").groupBy("target", "slot")
    rows = counted.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).toPandas()  # FEATURES rows per target at most
    model = Model()
    for k in range(len(TARGETS)):
        own = rows[rows["target"] == k]
        whole = own[own["slot"] == -1]
        docs, bad_docs = (int(whole[c].sum()) for c in ("n", "bad"))
        if not 0 < bad_docs < docs:
            continue
        part = own[own["slot"] >= 0]
        model.weights[k, part["slot"].to_numpy()] = _weights(part["bad"].to_numpy(), part["n"].to_numpy(), bad_docs, docs)
        model.prior[k] = np.log(bad_docs / (docs - bad_docs))
    return model


def fit(sample: DataFrame) -> Model:
    """Weights from the whole sample; slopes from documents held out, scored with the weights of the others."""
    sample = materialise(sample, "labelled")
    final, model = _weighted(sample), _weighted(sample.filter("NOT held"))

    def score(batches):
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                found = model.sums(data, at)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in found), *(batch.column(t)[first:last] for t in TARGETS)], names=["s0", "s1", *TARGETS])

    # one row of numbers per document of the sample, which is bounded
    scored = sample.filter("held").select("low", "toxic", "text").mapInArrow(score, "s0 double, s1 double, low int, toxic int").toPandas()
    for k, t in enumerate(TARGETS):
        if final.weights[k].any() and model.weights[k].any() and scored[t].nunique() == 2:
            final.slope[k], final.prior[k] = _fit_slope(scored[f"s{k}"].to_numpy(), scored[t].to_numpy().astype(float))
        elif final.weights[k].any():  # too few labels to hold any out: a cautious slope and the sample's prior
            final.slope[k] = FEW_LABELS_SLOPE
    return final


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, lang, low_llr, toxic_llr, n_words) of every document."""
    schema = "doc_id long, source string, lang string, n_words long, low_score double, toxic_score double"

    def run(batches):
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                found = model.sums(data, at) * model.slope[:, None] + model.prior[:, None]
                words = np.bincount(words_of(data, at)[2], minlength=last - first)
                found = np.where(words > 0, found, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[first:last] for c in ("doc_id", "source", "lang")), pa.array(words), *(pa.array(x) for x in found)],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(safe / (1 - safe))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _shrunk(sites: DataFrame, target: str, parent: Column) -> Column:
    """A site's rate drawn to its parent's, with the pseudo-count that the spread between sites shows."""
    return (F.col(f"{target}_sum") + F.col(f"{target}_weight") * parent) / (F.col("n") + F.col(f"{target}_weight"))


def _with_weights(sites: DataFrame) -> DataFrame:
    """Pseudo-counts by the method of moments: a rate's between-site variance beyond its sampling variance."""
    for t in TARGETS:
        rate = F.col(f"{t}_sum") / F.col("n")
        mean = F.sum(f"{t}_sum") / F.sum("n")
        spread = F.sum(F.col("n") * rate * rate) / F.sum("n") - mean * mean
        noise = mean * (1 - mean) * F.count("*") / F.sum("n")
        weight = F.least(F.greatest(mean * (1 - mean) / F.greatest(spread - noise, F.lit(1e-6)) - 1, F.lit(2.0)), F.lit(1e4))
        moments = sites.agg(weight.alias("w"))
        sites = sites.withColumn(f"{t}_weight", F.coalesce(moments.scalar(), F.lit(2.0)))
    return sites


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """One row per document: evidence, site rates, posterior probabilities and ``kept``."""
    model = fit(labelled_sample(docs, labels, most))
    scored = materialise(evidence(docs, model), "evidence")
    base = scored.withColumns({f"{t}_p": _sigmoid(F.col(f"{t}_score")) for t in TARGETS})
    sums = [F.count("*").alias("n"), *(F.sum(f"{t}_p").alias(f"{t}_sum") for t in TARGETS)]
    paths = materialise(base.groupBy("source", "lang").agg(*sums), "paths")
    hosts = _with_weights(paths.groupBy("source").agg(F.sum("n").alias("n"), *(F.sum(f"{t}_sum").alias(f"{t}_sum") for t in TARGETS)))
    whole = paths.agg(*((F.sum(f"{t}_sum") / F.sum("n")).alias(t) for t in TARGETS))
    for t in TARGETS:
        hosts = hosts.withColumn(f"{t}_global", whole.select(t).scalar())
    hosts = hosts.select(F.col("source").alias("_host"), *(_shrunk(hosts, t, F.col(f"{t}_global")).alias(f"{t}_host") for t in TARGETS), *(f"{t}_global" for t in TARGETS))
    joined = _with_weights(paths).join(hosts, F.expr("source <=> _host"))
    rates = joined.select(
        F.col("source").alias("_source"), F.col("lang").alias("_lang"), *(_shrunk(joined, t, F.col(f"{t}_host")).alias(f"{t}_path") for t in TARGETS),
        *(f"{t}_{x}" for t in TARGETS for x in ("host", "global")),
    )
    placed = scored.join(rates, F.expr("source <=> _source AND lang <=> _lang"))
    # the score holds the sample's prior; the path's replaces the global one
    posterior = {t: _sigmoid(F.col(f"{t}_score") + _logit(F.col(f"{t}_path")) - _logit(F.col(f"{t}_global"))) for t in TARGETS}
    return placed.select(
        "doc_id", "source", "lang", "n_words", *(f"{t}_score" for t in TARGETS), *(f"{t}_{x}" for t in TARGETS for x in ("host", "path")),
        *(p.alias(f"p_{t}") for t, p in posterior.items()), ((posterior["low"] <= 0.5) & (posterior["toxic"] <= 0.5)).alias("kept"),
    )
