"""Toxicity of documents: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: compatibility forms and homoglyphs become plain letters, lower
case; digits and signs that stand for letters are read as letters when they touch one
inside a word; what is no letter becomes one space.  Accents stay, since they tell words
of many languages apart, but an accented spelling of an unaccented lexicon word counts
as that word.  The automaton runs over the folded text and finds lexicon terms (whole
words, or beginnings of words) and exception phrases; a term inside an exception phrase
does not count.

The lexicon is learnt from a bounded sample of labelled training rows: words and word
beginnings whose smoothed log odds of the toxic label are high even at the lower end of
their interval, the longest of equally good nested ones, in toxic rows that the lexicon
does not explain yet, plus a short list of seed words whose weight also follows the labels.  Exceptions are the given phrases and pairs of
words around a term that only occur in rows labelled 0.  A logistic model over the hit
weights, normalised by the text's length, gives the score.

Rows: null and empty texts have no hits and score as such; rows that repeat an id score
each; a null id is not held out.  Without labels of both classes the seed lexicon
scores with fixed coefficients.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Emitter, rows_of
from .trees import sigmoid

# Labelled training rows that are used at most, those with the smallest hashes.
SAMPLE = 8_000
# Terms in the lexicon at most, by the lower end of their log odds.
MAX_TERMS = 2_000
# Characters of a word beginning, from and to.
STEMS = (4, 8)
# Toxic rows a term must occur in: a count, and a share of the toxic rows.
MIN_ROWS, MIN_SHARE = 6, 0.015
LEAST_ODDS, Z = 1.5, 1.64
SEED_WEIGHT = 3.0

# Seed words, harmless phrases, homoglyphs, digits and signs read as letters.
SEEDS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum",
         "trash", "clown", "imbecile", "filth", "vermin", "dumb")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "dumb bell", "idiot proof")
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "һ": "h", "ӏ": "l", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʀ": "r",
}
LETTER_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a",
                "$": "s", "!": "i", "|": "l", "+": "t"}

_GLYPHS = str.maketrans(HOMOGLYPHS)
_SIGNS = str.maketrans(LETTER_SIGNS)
_SIGN_CLASS = "[" + re.escape("".join(LETTER_SIGNS)) + "]"
# Signs between letters, or digits and @ $ at the start of a word of letters.
_STANDING_IN = re.compile(rf"(?<=[a-z]){_SIGN_CLASS}{{1,3}}(?=[a-z])|(?<![^\s])[013457@$](?=[a-z][a-z013457@$])")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_OTHER = re.compile(r"[\W\d_]+")


def folded(text: str | None) -> str:
    """Folded words with single spaces between and around them."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).lower().translate(_GLYPHS)
    else:
        text = text.lower()
    text = _STANDING_IN.sub(lambda m: m[0].translate(_SIGNS), text)
    return f" {_OTHER.sub(' ', text).strip()} "


def unaccented(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def terms(text: str) -> set[str]:
    """Words (" word ") and word beginnings (" wor") of a folded text."""
    out = set()
    for word in set(text.split()):
        out.add(f" {word} ")
        for n in range(STEMS[0], min(STEMS[1], len(word) - 1) + 1):
            out.add(f" {word[:n]}")
    return out


class Matcher:
    """Automaton of a lexicon's terms and exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms in a folded text outside exception phrases."""
        found, excused = [], []
        if not len(self.automaton):
            return found
        for end, (length, weight) in self.automaton.iter(text):
            place = (end + 1 - length, end + 1)
            if weight is None:
                excused.append(place)
            else:
                found.append((*place, weight))
        if excused:
            found = [h for h in found if not any(s <= h[0] and h[1] <= e for s, e in excused)]
        return found

    def features(self, text: str) -> tuple[float, float, float]:
        """Any hit, the logarithm of the summed weights, and their density by length."""
        total = sum(w for *_, w in self.hits(text))
        if not text.isascii():
            total += sum(self.weights.get(f" {unaccented(w)} ", 0.0)
                         for w in text.split() if not w.isascii())
        words = text.count(" ")
        return (float(total > 0), float(np.log1p(total)),
                float(np.log1p(100 * total / (words + 20))))


@dataclass
class Lexicon:
    """Weights of terms, exception phrases, and the logistic model over hit features."""
    weights: dict[str, float]
    exceptions: list[str]
    coefficients: list[float] = field(default_factory=lambda: [-3.0, 3.0, 1.0, 0.5])

    def matcher(self) -> Matcher:
        return Matcher(self.weights, self.exceptions)

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        matcher = self.matcher()
        x = np.array([matcher.features(folded(t)) for t in texts]).reshape(-1, 3)
        return sigmoid(self.coefficients[0] + x @ np.array(self.coefficients[1:]))


def _odds(a: int, b: int, toxic: int, clean: int) -> float:
    """Smoothed log odds ratio of a term in a of the toxic and b of the clean rows."""
    return float(np.log((a + 0.5) / (toxic - a + 0.5)) - np.log((b + 0.5) / (clean - b + 0.5)))


def _best_terms(counts: list[tuple], holders: list[set[str]], toxic: int,
                clean: int) -> dict[str, float]:
    """Lexicon from candidates (term, a, b), best first; holders: terms of toxic rows.

    Rows that already hold two terms of the lexicon are explained and speak for no other
    term, so words that only come along in copies of a toxic text stay out.
    """
    weights = {f" {s} ": SEED_WEIGHT for s in SEEDS}
    least = max(MIN_ROWS, MIN_SHARE * toxic)
    rows_with: dict[str, list[int]] = {}
    for i, held in enumerate(holders):
        for term in held:
            rows_with.setdefault(term, []).append(i)
    found = [0] * len(holders)

    def take(term: str, weight: float) -> None:
        weights[term] = weight
        for i in rows_with.get(term, ()):
            found[i] += 1

    for term, a, b in counts:
        if term in weights:
            take(term, max(0.0, _odds(a, b, toxic, clean)))
    for term, a, b in counts:
        if term in weights or any(term.startswith(t) or t.startswith(term) for t in weights):
            continue
        if sum(found[i] < 2 for i in rows_with.get(term, ())) >= least:
            take(term, _odds(a, b, toxic, clean))
    return {t: w for t, w in weights.items() if w > 0}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> list[float]:
    """Ridge logistic regression by Newton steps; the first coefficient is the constant."""
    x = np.hstack((np.ones((len(x), 1)), x))
    beta = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(beta))
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep,
                               x.T @ (y - p) - keep @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def fit_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Lexicon and model from at most ``sample`` labelled rows.

    Counts of terms are aggregated by Spark; at most ``MAX_TERMS`` terms, and of each
    sampled row its candidate terms and three numbers, reach the driver.
    """
    key = F.col(id_col).cast("long")
    chosen = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .filter(~held_out(key)).select(key.alias("id"), F.col(label_col).cast("int").alias("label"))
              .groupBy("id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))
    # The sample has at most ``sample`` rows of 12 bytes, so its broadcast is bounded.
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), "id").select("label", "text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("term", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            held = (Counter(), Counter())
            for label, text in rows_of([batch], "label", "text"):
                held[1 - label].update(terms(folded(text)))
            out = Emitter(schema, max_rows=1 << 16)
            for term in held[0].keys() | held[1].keys():
                out.add((term, held[0][term], held[1][term]))
            yield out.batch()

    counts = rows.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    sizes = rows.groupBy("label").count().collect()
    toxic = next((r["count"] for r in sizes if r.label == 1), 0)
    clean = next((r["count"] for r in sizes if r.label == 0), 0)
    if not toxic or not clean:
        return Lexicon({f" {s} ": SEED_WEIGHT for s in SEEDS}, list(EXCEPTIONS))
    odds = (F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5))
            - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5)))
    low = odds - Z * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    seeded = F.col("term").isin([f" {s} " for s in SEEDS])
    best = (counts
            .filter(seeded | ((low >= LEAST_ODDS) & (F.col("a") >= max(MIN_ROWS, MIN_SHARE * toxic))))
            .orderBy(seeded.desc(), low.desc(), F.length("term").desc(), "term").limit(MAX_TERMS))
    candidates = [(r.term, r.a, r.b) for r in best.collect()]
    known = {c[0] for c in candidates}

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms(folded(t)) & known) for (t,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["held"])

    holders = [set(r.held) for r in rows.filter("label = 1").select("text")
               .mapInArrow(held, "held array<string>").limit(sample).collect()]
    weights = _best_terms(candidates, holders, toxic, clean)
    lexicon = Lexicon(weights, [])
    lexicon.exceptions = sorted({*EXCEPTIONS, *_harmless(rows, lexicon)})

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        out = Emitter(pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))]))
        for label, text in rows_of(batches, "label", "text"):
            out.add((label, matcher.features(folded(text))))
            if out.full:
                yield out.batch()
        yield out.batch()

    seen = rows.mapInArrow(measure, "label int, x array<double>").limit(sample).collect()
    lexicon.coefficients = _logistic(np.array([r.x for r in seen]),
                                     np.array([r.label for r in seen]))
    return lexicon


def _harmless(rows: DataFrame, lexicon: Lexicon, least: int = 5) -> list[str]:
    """Two-word phrases around a term that ``least`` clean rows hold and no toxic row."""
    def phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            found: Counter = Counter()
            for label, text in rows_of([batch], "label", "text"):
                text = folded(text)
                near = set()
                for start, end, _ in matcher.hits(text):
                    end = text.index(" ", end - 1)
                    word = text[start:end].strip()
                    before, after = text[:start].rpartition(" ")[2], text[end + 1:].partition(" ")[0]
                    near |= {p for p in (f"{before} {word}" if before else "",
                                         f"{word} {after}" if after else "") if p}
                found.update((p, label) for p in near)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.string()),
                 pa.array([label for _, label in found], pa.int32()),
                 pa.array(list(found.values()), pa.int64())], names=["phrase", "label", "n"])

    table = rows.mapInArrow(phrases, "phrase string, label int, n long")
    good = (table.groupBy("phrase").agg(F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("clean"),
                                        F.max("label").alias("worst"))
            .filter((F.col("worst") == 0) & (F.col("clean") >= least))
            .orderBy(F.col("clean").desc(), "phrase").limit(MAX_TERMS))
    return [r.phrase for r in good.collect()]


def held_out(key: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    lexicon = fit_lexicon(docs, labels, id_col, text_col, sample=sample)

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lexicon.score(batch.column(1).to_pylist()))],
                names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scores, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
