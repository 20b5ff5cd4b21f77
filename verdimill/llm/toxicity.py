"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks for its two ends) and
itself; every n-gram has a vector, which is 0 for those that say nothing about
the label.  A word's vector is the mean of its bag's vectors, a passage's the
mean of its words', and a softmax layer over two classes reads it.  Vectors and layer are trained
together.  A text is as toxic as its most toxic passage, so one insult in a long
text is not averaged away; in training the label of a text acts on
that passage.  Misspellings never seen share n-grams with words that were.

Because everything up to the softmax is linear, a trained word is one number,
its share of the log-odds; scoring adds these up.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes, tidied, unused

#: Labelled rows of each class that training takes at most (the sample's documented bound).
SAMPLE_TOXIC, SAMPLE_CLEAN = 700, 1400
DIM, GRAMS = 6, (3, 4, 5, 6)
PASSAGE, STEPS, RATE = 40, 40, 0.05
#: Least association of an n-gram with the label, as the signed root of a likelihood ratio.
MIN_STRENGTH = 4.0
#: Texts shorter than this are averaged as if neutral words filled them up.
LEAST = 8
THRESHOLD = 0.3
CACHE = 200_000
_EDGE = b".,;:!?\"'()[]{}*#$%&"


def subwords(word: bytes) -> list[str]:
    """A word's bag: itself and its character n-grams, with ends marked."""
    marked = f"<{word.strip(_EDGE).decode('utf-8', 'replace').lower()}>"
    n = len(marked)
    return [marked, *(marked[i : i + k] for k in GRAMS for i in range(n - k + 1))]


@dataclass
class Model:
    """share: log-odds of each telling n-gram; bias: of every passage; scale and shift: calibration of a text's log-odds."""

    share: dict[str, float]
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def word(self, w: bytes) -> float:
        bag = subwords(w)
        known = self.share.keys() & bag
        return sum(self.share[g] * bag.count(g) for g in known) / len(bag) if known else 0.0


class Values(dict):
    """The values of words under a model: those seen first are kept, others are computed each time.

    An automaton finds the telling n-grams of a word; the words of a corpus are too many for a lookup of each n-gram.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.share = model.share
        self.automaton = ahocorasick.Automaton()
        for gram, x in model.share.items():
            if GRAMS[0] <= len(gram) <= GRAMS[-1]:
                self.automaton.add_word(gram, x)
        self.automaton.make_automaton()

    def __missing__(self, w: bytes) -> float:
        marked = f"<{w.strip(_EDGE).decode('utf-8', 'replace').lower()}>"
        n = len(marked)
        value = self.share.get(marked, 0.0)  # the word itself; its n-grams follow
        if len(self.automaton):
            value += sum(x for _, x in self.automaton.iter(marked))
        if value:
            value /= 1 + sum(max(n - k + 1, 0) for k in GRAMS)
        if len(self) < CACHE:
            self[w] = value
        return value


def _passages(n: int) -> np.ndarray:
    """Starts of the passages of n words: PASSAGE long, half overlapping, the last one at the end."""
    if n <= PASSAGE:
        return np.zeros(1, np.int64)
    return np.unique(np.r_[np.arange(0, n - PASSAGE, PASSAGE // 2), n - PASSAGE])


def first_uses(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """False where the same word stands less than a passage before (at: positions): repeating a word adds nothing."""
    order = np.argsort(ids, kind="stable")
    s, p = ids[order], at[order]
    out = np.ones(len(ids), bool)
    out[order[1:][(s[1:] == s[:-1]) & (p[1:] - p[:-1] < PASSAGE)]] = False
    return out


def log_odds(words: list, value: dict) -> float:
    """The highest mean of a passage of a text, given the values of its words."""
    n = len(words)
    values = np.fromiter(map(value.__getitem__, words), np.float64, n)
    at = np.flatnonzero(values)
    if not len(at):
        return 0.0
    number: dict = {}
    ids = np.fromiter((number.setdefault(words[i], len(number)) for i in at.tolist()), np.int64, len(at))
    values[at[~first_uses(ids, at)]] = 0.0
    if n <= PASSAGE:
        return float(values.sum() / max(n, LEAST))
    total = np.r_[0.0, np.cumsum(values)]
    p = _passages(n)
    return float((total[p + PASSAGE] - total[p]).max() / PASSAGE)


def _association(t: np.ndarray, c: np.ndarray, n_t: float, n_c: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and strength (root of twice the log likelihood ratio) of buckets found in t toxic and c clean texts."""
    odds = np.log((t + 0.5) / (n_t + 1)) - np.log((c + 0.5) / (n_c + 1))
    n, got = n_t + n_c, t + c
    ratio = np.zeros(len(t))
    for seen, all_of in ((t, n_t), (c, n_c)):
        for part, whole in ((seen, got), (all_of - seen, n - got)):
            expected = np.maximum(whole * all_of / n, 1e-12)
            ratio += np.where(part > 0, part * np.log(np.maximum(part, 1e-12) / expected), 0.0)
    return odds, np.sqrt(np.maximum(2 * ratio, 0))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def train(texts: list[bytes] | Iterator[bytes], labels: list[int], steps: int = STEPS, seed: int = 7) -> Model | None:
    """Fit vectors and softmax; None unless both classes occur."""
    number: dict[bytes, int] = {}
    docs = []
    for t in texts:
        w = t.split()
        docs.append(np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w)))
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    grams: dict[str, int] = {}
    bags = [[grams.setdefault(g, len(grams)) for g in subwords(w)] for w in number]
    sizes = np.array([len(b) for b in bags], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.fromiter((g for b in bags for g in b), np.int64, int(sizes.sum()))
    del bags
    # n-grams whose texts tell nothing about the label keep the vector 0, so that chance is not learned.
    with_t, with_c = np.zeros(len(grams)), np.zeros(len(grams))
    for d, label in zip(docs, y, strict=True):
        u = np.unique(d)
        (with_t if label > 0 else with_c)[np.unique(flat[_ranges(starts[u], sizes[u])])] += 1
    odds, strength = _association(with_t, with_c, float(y.sum()), float(len(y) - y.sum()))
    telling = np.flatnonzero(strength >= MIN_STRENGTH)
    names = list(grams)
    names = [names[k] for k in telling]
    slot = np.full(len(grams), -1, np.int64)
    slot[telling] = np.arange(len(telling))
    # Only words with a telling n-gram count from here on: pairs (word, n-gram) and the places of these words.
    gram, owner = slot[flat], np.repeat(np.arange(len(sizes)), sizes)
    gram, owner = gram[gram >= 0], owner[gram >= 0]
    live = np.zeros(len(sizes), bool)
    live[owner] = True
    short = np.cumsum(live) - 1
    owner, bag = short[owner], np.maximum(sizes[live], 1).astype(np.float64)
    n_live = int(live.sum())
    words, places, begin, end, doc, at = [], [], [], [], [], 0
    for k, d in enumerate(docs):
        here = np.flatnonzero(live[d])
        here = here[first_uses(d[here], here)] if len(here) else here
        words.append(short[d[here]])
        places.append(at + here)
        p = _passages(len(d))
        begin.append(at + p)
        end.append(at + np.minimum(p + PASSAGE, len(d)))
        doc.append(np.full(len(p), k))
        at += len(d)
    words, places, begin, end, doc = map(np.concatenate, (words, places, begin, end, doc))
    size = np.maximum(end - begin, LEAST).astype(np.float64)
    begin, end = np.searchsorted(places, begin), np.searchsorted(places, end)
    docs_at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    of_doc = np.bincount(doc, minlength=len(docs))
    rng = np.random.default_rng(seed)
    vec = rng.normal(0, 0.1, (len(telling), DIM))
    vec[:, 0] = odds[telling]  # the first coordinate starts from the counts
    out = rng.normal(0, 0.1, (DIM, 2))
    out[0] = -0.5, 0.5
    bias = np.zeros(2)
    params, m1, m2 = [vec, out, bias], [0.0] * 3, [0.0] * 3
    class_w = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))

    def spread(values: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(to, values[:, j], minlength=n) for j in range(DIM)], axis=1) if n else np.zeros((0, DIM))

    for step in range(1, steps + 1):
        wv = spread(vec[gram], owner, n_live) / bag[:, None]
        total = np.zeros((len(words) + 1, DIM))
        np.cumsum(wv[words], axis=0, out=total[1:])
        mean = (total[end] - total[begin]) / size[:, None]
        z = mean @ out + bias
        d = z[:, 1] - z[:, 0]
        p = 1 / (1 + np.exp(-np.clip(d, -30, 30)))
        if step <= steps // 4:  # first, all passages of a text carry its label
            g = (p - y[doc]) * class_w[doc] / of_doc[doc] / len(docs)
        else:  # then its most toxic one
            best = np.maximum.reduceat(d, docs_at)
            hit = np.flatnonzero(d >= best[doc])
            hit = hit[np.r_[True, doc[hit][1:] != doc[hit][:-1]]]
            g = np.zeros(len(d))
            g[hit] = (p[hit] - y[doc[hit]]) * class_w[doc[hit]] / len(docs)
        gz = np.stack([-g, g], axis=1)
        gm = (gz @ out.T) / size[:, None]
        edge = spread(gm, begin, len(words) + 1) - spread(gm, end, len(words) + 1)
        g_word = spread(np.cumsum(edge[:-1], axis=0), words, n_live) / bag[:, None]
        for k, gx in enumerate((spread(g_word[owner], gram, len(telling)), mean.T @ gz + 1e-5 * out, gz.sum(0))):
            m1[k] = 0.9 * m1[k] + 0.1 * gx
            m2[k] = 0.99 * m2[k] + 0.01 * gx * gx
            params[k] -= RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    share = vec @ (out[:, 1] - out[:, 0])
    model = Model(dict(zip(names, share.tolist(), strict=True)), float(bias[1] - bias[0]))
    # Calibration on the same texts: the cut with the best F1 gets the score THRESHOLD.
    by_word = np.zeros(len(sizes))
    by_word[live] = np.bincount(owner, share[gram], minlength=n_live) / bag
    value = dict(enumerate(by_word.tolist()))
    odds = np.array([log_odds(d.tolist(), value) for d in docs])
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    below = odds[order[k + 1]] if k + 1 < len(y) else odds[order[k]] - 1.0
    model.shift = float((odds[order[k]] + below) / 2)
    spread = float(np.median(odds[y > 0]) - np.median(odds[y == 0]))
    model.scale = 8.0 / spread if spread > 1e-6 else 1.0
    return model


def _score(odds: float, model: Model) -> float:
    z = model.scale * (odds - model.shift) + np.log(THRESHOLD / (1 - THRESHOLD))
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see; a null id is not held out, and never labelled either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Train on at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled rows that aren't held out, chosen by the hash of their id."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = F.xxhash64("doc_id")
    some = lambda cond, n: marked.where(cond).orderBy(by, "doc_id").limit(n)
    sample = some("toxic = 1", SAMPLE_TOXIC).unionByName(some("toxic <> 1", SAMPLE_CLEAN)).select(F.col("doc_id").alias("l_id"), "toxic")
    one = documents.select("doc_id", text_bytes().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))
    kept = one.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    rows = kept.sortWithinPartitions("doc_id").collect()  # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
    rows.sort(key=lambda r: r.doc_id)
    return train([bytes(r.text) for r in rows], [int(r.toxic == 1) for r in rows])


#: The model of this process and the values of words seen.
_LOADED: dict[str, tuple[Model, Values]] = {}


def score_documents(documents: DataFrame, model: Model | None, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``documents`` with columns ``score`` and ``predicted``, replaced if there; without a model every score is 0.

    A null or empty text scores like a text of neutral words; equal texts score alike.
    """
    documents = documents.drop(score, predicted)
    if model is None:
        return documents.withColumns({score: F.lit(0.0), predicted: F.lit(0)})
    data = pickle.dumps(model)
    sent = documents.sparkSession.sparkContext.broadcast(data)  # the telling n-grams of a bounded sample
    name = hashlib.sha256(data).hexdigest()

    rows = small_batches(documents).withColumn(score, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LOADED:
            _LOADED.clear()
            m = pickle.loads(sent.value)
            _LOADED[name] = m, Values(m)
        m, known = _LOADED[name]
        for batch in batches:
            found = []
            for t in batch.column(batch.schema.get_field_index("text")):
                words = (t.as_py() or "").encode().split()
                found.append(_score(log_odds(words, known), m))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()) if n == score else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return rows.mapInArrow(tidied(run), rows.schema).withColumn(predicted, (F.col(score) >= THRESHOLD).cast("int"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text of ``documents``, repeated rows included.

    A null or empty text scores like neutral words; a null doc_id is not held
    out.  Of several labels of a doc_id the largest counts.  Without labels of both kinds every score is 0.
    """
    rows = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score_documents(rows, fit(documents, labels)).select("doc_id", "held_out", "score", "predicted")


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without the rows predicted toxic; columns unchanged, whatever their names.

    Null and empty texts and rows without doc_id are scored like others; repeated rows go or stay together.
    """
    score, predicted = unused(documents, "score", "predicted")
    return score_documents(documents, fit(documents, labels), score, predicted).where(F.col(predicted) == 0).drop(score, predicted)
