"""A counterfactually regularised toxicity classifier.

Features are the distinct lower-cased words of a text and their leading 4, 5 and 6 letters (so that inflected
or compounded forms of a learned stem count), chosen by how strongly and how often they go with a label.
The model is logistic regression; besides log loss and an L2 penalty it is charged for the squared change
of the logit when the identity terms of a labelled text are swapped for another term of the same kind, so
that neutral mentions of a group do not by themselves raise or lower a score. A text's tokens are swapped
kind by kind: every term of a kind, whichever it is, becomes the one after the first that occurs, so that a
text which names two groups of a kind differs from its swapped form too.

Fitting: on at most `most_rows` labelled rows (the bound; rows are chosen by a hash of the id, so that any
larger table gives a sample of the same size). Their features are made on the executors; the driver gets
hashed features, not texts. Scoring is one pass of Arrow batches over all whole texts with the few
thousand weights that were kept, without a shuffle.

Defined cases: null and empty texts have no features and get the model's base rate; null labels are not
learned from; with no labelled rows, or rows of one label only, every score is the share of toxic labels
(0 if none); repeated rows get equal scores; an id that is labelled twice
teaches twice, and one that several documents have with each of them, within the bound; of features that go equally with the
labels those of the least hashes are chosen; very long texts are read whole; other columns are not carried.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credenza.llm.common import Memo, held_out, slices

#: Identity terms by kind. A term is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("mother", "father"), ("she", "he"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("old", "young"), ("blind", "sighted"), ("deaf", "hearing"), ("immigrant", "native"), ("immigrants", "natives"),
    ("american", "mexican", "chinese", "german", "french", "spanish", "indian", "turkish"),
    ("frau", "mann"), ("frauen", "männer"), ("femme", "homme"), ("femmes", "hommes"), ("mujer", "hombre"), ("mujeres", "hombres"),
)
NEXT = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}
KIND = {term: i for i, kind in enumerate(IDENTITY_TERMS) for term in kind}
WORDS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def swapped_words(text: str) -> set[str]:
    """The words of the text once its identity terms are swapped."""
    becomes: dict[int, str] = {}
    out = set()
    for word in WORDS.findall(text.lower()):
        kind = KIND.get(word)
        out.add(word if kind is None else becomes.setdefault(kind, NEXT[word]))
    return out


def features_of_word(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def features_of(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of_word(w)}


def feature_hash(feature: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(feature) >> 33


def labelled_features(batches):
    """(key, text, toxic) to (key, toxic, hashed features, hashed features after the swap or null if it changes nothing)."""
    for batch in batches:
        for part in slices(batch):
            plain, swapped = [], []
            for text in part.column("text").to_pylist():
                words = words_of(text or "")
                plain.append(sorted(map(feature_hash, features_of(words))))
                other = swapped_words(text or "")
                swapped.append(sorted(map(feature_hash, features_of(other))) if other != words else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("toxic"), pa.array(plain, kind), pa.array(swapped, kind)], ["key", "toxic", "plain", "swapped"])


def choose(rows: list[np.ndarray], y: np.ndarray, most: int, least_docs: int) -> np.ndarray:
    """Hashes of the features with the largest chi-square between presence and label, sorted."""
    flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)
    label = np.repeat(y, [len(r) for r in rows])
    names, where, n = np.unique(flat, return_inverse=True, return_counts=True)
    toxic = np.bincount(where, weights=label, minlength=len(names))
    total, share = len(y), y.mean()
    expected = n * share
    chi = (toxic - expected) ** 2 / np.maximum(expected, 1e-9) + ((n - toxic) - n * (1 - share)) ** 2 / np.maximum(n * (1 - share), 1e-9)
    chi = chi * total / np.maximum(total - n, 1)
    chi[n < least_docs] = -1
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(names[best[chi[best] > 4]])


def matrix(rows: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the chosen features present."""
    flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.searchsorted(chosen, flat)
    hit = (at < len(chosen)) & (chosen[np.minimum(at, max(0, len(chosen) - 1))] == flat) if len(chosen) else np.zeros(len(flat), dtype=bool)
    return row[hit], at[hit]


def logits(w: np.ndarray, places: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    row, column = places
    return np.bincount(row, weights=w[column], minlength=n)


def loss(w: np.ndarray, b: float, data: tuple, l2: float, counterfactual: float) -> float:
    """Mean log loss, L2 penalty and mean squared change of the logit over the texts that the swap changes."""
    plain, before, after, y, k = data
    z = logits(w, plain, len(y)) + b
    gap = logits(w, before, k) - logits(w, after, k)
    return float(np.mean(np.logaddexp(0, z) - y * z) + l2 * (w @ w) / (2 * len(y)) + (counterfactual * np.mean(gap * gap) if k else 0.0))


def gradient(w: np.ndarray, b: float, data: tuple, l2: float, counterfactual: float) -> np.ndarray:
    """Of loss(), by the weights and the intercept."""
    plain, before, after, y, k = data
    error = (1 / (1 + np.exp(-np.clip(logits(w, plain, len(y)) + b, -30, 30))) - y) / len(y)
    grad = np.bincount(plain[1], weights=error[plain[0]], minlength=len(w)) + l2 * w / len(y)
    if k:
        gap = (logits(w, before, k) - logits(w, after, k)) * (2 * counterfactual / k)
        grad += np.bincount(before[1], weights=gap[before[0]], minlength=len(w)) - np.bincount(after[1], weights=gap[after[0]], minlength=len(w))
    return np.r_[grad, error.sum()]


def fit(plain: list[np.ndarray], swapped: list[np.ndarray | None], y: np.ndarray, most_features: int, least_docs: int, l2: float, counterfactual: float, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen feature hashes, their weights and the intercept, by full-batch Adam (deterministic)."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return np.empty(0, dtype=np.int64), np.empty(0), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    chosen = choose(plain, y, most_features, least_docs)
    pairs = [i for i, s in enumerate(swapped) if s is not None]
    data = (matrix(plain, chosen), matrix([plain[i] for i in pairs], chosen), matrix([swapped[i] for i in pairs], chosen), y, len(pairs))
    w, b = np.zeros(len(chosen)), float(np.log(share / (1 - share)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = gradient(w, b, data, l2, counterfactual)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    return chosen, w, b


def scorer(chosen: np.ndarray, weights: np.ndarray, intercept: float):
    """Batches of (id, text) to (id, score)."""
    hashes, values = chosen.tolist(), weights.tolist()

    def run(batches):
        place = {h: i for i, h in enumerate(hashes)}
        memo = Memo(48 << 20)
        for batch in batches:
            for part in slices(batch):
                scores = []
                for text in part.column("text").to_pylist():
                    present: set[int] = set()
                    words = words_of(text or "")
                    hits = list(map(memo.get, words))
                    for word, hit in zip(words, hits, strict=True):
                        if hit is None:
                            hit = memo.keep(word, tuple(place[h] for h in map(feature_hash, features_of_word(word)) if h in place), 2 * len(word) + 64)
                        if hit:
                            present.update(hit)
                    z = intercept + sum(values[i] for i in sorted(present))
                    scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.3, most_rows: int = 12_000, most_features: int = 4096, least_docs: int = 4, l2: float = 1.0, counterfactual: float = 4.0, steps: int = 300, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row: id, held_out, score, predicted. Rows whose crc32(id) mod modulus is remainder are never learned from."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("toxic")).filter("l_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out("l_id", modulus, remainder))
    # Bounded: at most most_rows ids and labels are broadcast, and at most as many rows of hashed features collected, by a
    # hash of id and text, also where one labelled id stands in many rows.
    sample = known.orderBy(F.xxhash64("l_id"), "l_id", "toxic").limit(most_rows)
    learned = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("d_id") == F.col("l_id")).select(F.xxhash64("l_id", "text").alias("key"), "text", "toxic")
    features = learned.mapInArrow(labelled_features, "key bigint, toxic int, plain array<int>, swapped array<int>")
    table = features.orderBy("key", "toxic", "plain").limit(most_rows).toArrow()
    plain, swapped = ([None if not v.is_valid else v.values.to_numpy() for v in table.column(c)] for c in ("plain", "swapped"))
    y = np.array([float(t > 0) for t in table.column("toxic").to_pylist()])
    model = fit(plain, swapped, y, most_features, least_docs, l2, counterfactual, steps)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    scored = narrow.mapInArrow(scorer(*model), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
