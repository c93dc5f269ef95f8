"""Quality of documents: classifier evidence combined with site posteriors.

Boosted trees fitted on a bounded sample of labelled rows give each document a log
likelihood ratio (its log odds less those of the sample).  Sites are a host and a path
below it; for documents these are the source and the language.  Grouped aggregation sums
the documents' probabilities by path, host and over all.  Hierarchical empirical Bayes
shrinks a host's mean to the global one and a path's mean to its host's; the strengths
come from the spread between hosts and between the paths of a host (method of moments),
so a site with few documents keeps close to its parent.  A document's own probability is
left out of its path's posterior.  The score is the logistic of evidence plus the log
odds of the path's posterior; documents that score at least 0.5 are kept.

Rows: a null or empty text has the features of an empty text; null hosts and paths are
sites of their own; repeated rows count each.  Without labelled rows of both classes the
evidence is 0 and every document is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import added, rows_of, run_folder, stored

# Labelled rows that the classifier is fitted on at most, those with the smallest hashes.
SAMPLE = 10_000
KEEP_FROM = 0.5
# Bounds of a site prior's strength, in documents.
STRENGTH = (2.0, 10_000.0)

_KINDS = np.zeros(256, dtype=np.int64)
for _kind, _chars in enumerate([b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)),
                                bytes(range(65, 91)), b"0123456789", b".,;:'\"()-?", b"|", b"!",
                                bytes(range(128, 256))], 1):
    _KINDS[list(_chars)] = _kind
N_FEATURES = 18


def features(text: str | None) -> np.ndarray:
    """Shares of character kinds, and repetition and length of words and lines."""
    raw = (text or "").encode()
    if not raw:
        return np.zeros(N_FEATURES)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, dtype=np.uint8)], minlength=10)
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = kinds[3] + kinds[4]
    folded = [w.lower() for w in words]
    twice = sum(map(bytes.__eq__, folded, folded[1:]))
    pairs = len(set(zip(folded, folded[1:])))
    return np.concatenate((
        kinds / len(raw),
        [kinds[4] / (letters + 1), n and len(set(folded)) / n, twice / (n or 1),
         pairs / max(1, n - 1), len(raw) / (n or 1), np.log1p(n),
         len(set(lines)) / (len(lines) or 1), np.log1p(len(raw) / (len(lines) or 1))]))


@dataclass
class Classifier:
    """Document evidence: log odds of good quality less those of the training sample."""
    model: trees.Trees | None

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None or not texts:
            return np.zeros(len(texts))
        x = np.array([features(t) for t in texts])
        return self.model.margin(x) - self.model.base


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "quality",
                   sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` labelled documents; the sample reaches the driver."""
    chosen = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .select(F.col(id_col).cast("long").alias("id"),
                      F.col(label_col).cast("int").alias("label"))
              .groupBy("id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for (t,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("label")),
                 pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    # The sample has at most ``sample`` rows of 12 bytes, so its broadcast is bounded.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = (rows.join(F.broadcast(chosen), "id").select("label", "text")
             .mapInArrow(measured, "label int, x array<double>").limit(sample).collect())
    y = np.array([r.label for r in found])
    if len(found) == 0 or y.min() == y.max():
        return Classifier(None)
    return Classifier(trees.fit(np.array([r.x for r in found]), y))


def _strength(mean: float, spread: float) -> float:
    """Documents that a prior with this mean and variance between sites is worth."""
    low, high = STRENGTH
    return min(high, max(low, mean * (1 - mean) / spread - 1)) if spread > 0 else high


def site_priors(scored: DataFrame, folder: str) -> tuple[DataFrame, float]:
    """Path table (host, path, total, n, centre) and the strength of a path's prior.

    ``scored`` has host, path and p.  ``centre`` is the posterior mean of the path's host.
    Sites are as many rows as the corpus has paths; three rows of totals reach the driver.
    """
    paths = stored(scored.groupBy("host", "path").agg(
        F.sum("p").alias("total"), F.count(F.lit(1)).alias("n")), f"{folder}/paths")
    hosts = stored(paths.groupBy("host").agg(
        F.sum("total").alias("host_total"), F.sum("n").alias("host_n")), f"{folder}/hosts")
    sums = hosts.agg(F.sum("host_total").alias("t"), F.sum("host_n").alias("n"),
                     F.count(F.lit(1)).alias("k")).first()
    mean = min(1 - 1e-6, max(1e-6, sums.t / sums.n)) if sums.n else 0.5
    between = hosts.agg(F.sum(F.col("host_n") * F.pow(
        F.col("host_total") / F.col("host_n") - mean, 2)).alias("v")).first().v or 0.0
    noise = mean * (1 - mean)
    strength = _strength(mean, (between - (sums.k - 1) * noise) / sums.n if sums.n else 0.0)
    hosts = hosts.withColumn("centre", (F.col("host_total") + strength * mean)
                             / (F.col("host_n") + strength))
    placed = stored(
        paths.alias("p").join(hosts.alias("h"), F.expr("p.host <=> h.host")).select(
            "p.host", "p.path", "total", "n", "centre"), f"{folder}/priors")
    within = placed.agg(
        F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - F.col("centre"), 2)).alias("v"),
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    spread = (within.v - within.k * noise) / within.n if within.n else 0.0
    return placed, _strength(mean, spread)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def scored_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", host_col: str = "source", path_col: str = "lang",
                     sample: int = SAMPLE, drop_text: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with added columns; their names by role: evidence, prior, score.

    ``drop_text`` leaves the texts out of the result.
    """
    folder = run_folder(docs.sparkSession, "quality")
    classifier = fit_classifier(docs, labels, id_col, text_col, sample=sample)
    docs, evidence = added(docs, text_col, "evidence", pa.float64(), classifier.evidence)
    if drop_text:
        # Written once: the sites and the scores both read it.  With the texts it would be a
        # second copy of the corpus, so then the evidence is computed for each of them.
        docs = stored(docs.drop(text_col), f"{folder}/evidence")
    base = classifier.model.base if classifier.model else 0.0
    p = 1 / (1 + F.exp(-(F.col(evidence) + base)))
    # A prior of 1 - 1e-6 where nothing was learnt: every document is kept.
    sites = docs.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"),
                        (p if classifier.model else F.lit(1.0)).alias("p"))
    priors, strength = site_priors(sites, folder)
    names = {c: f"{c}_{evidence}" for c in ("total", "n", "centre", "host", "path")}
    priors = priors.select(*(F.col(c).alias(x) for c, x in names.items()))
    own = p if classifier.model else F.lit(1.0)
    prior = ((F.col(names["total"]) - own + strength * F.col(names["centre"]))
             / (F.col(names["n"]) - 1 + strength))
    out = docs.join(priors, F.col(host_col).eqNullSafe(F.col(names["host"]))
                    & F.col(path_col).eqNullSafe(F.col(names["path"])), "left")
    roles = {"evidence": evidence, "prior": f"prior_{evidence}", "score": f"score_{evidence}"}
    out = (out.withColumn(roles["prior"], prior)
           .withColumn(roles["score"],
                       1 / (1 + F.exp(-(F.col(evidence) + _logit(F.col(roles["prior"]))))))
           .drop(*names.values()))
    return out, roles


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, evidence, prior, score, kept."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    scored, roles = scored_documents(rows, labels.withColumnRenamed(id_col, "id"), "id", "text",
                                     "host", "path", sample, drop_text=True)
    return scored.select(
        F.col("id").alias("doc_id"), *(F.col(c).alias(role) for role, c in roles.items()),
        (F.col(roles["score"]) >= KEEP_FROM).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    scored, roles = scored_documents(docs, labels, **options)
    return scored.filter(F.col(roles["score"]) >= KEEP_FROM).select(*docs.columns)
