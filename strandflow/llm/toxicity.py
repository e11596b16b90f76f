"""Toxicity: a support vector machine on the gapped subsequence string kernel.

The kernel of two words compares all subsequences of three characters, each weighted by ``DECAY`` to the power of
the stretch it spans (gaps up to ``SPAN``), normalised to the words' own norms: an insult with inserted,
split or changed characters keeps most of its subsequences.  Landmark words give a Nyström
feature map; a linear machine with squared hinge loss is trained on it.  A document is judged by
its ``WORST`` worst words and by how many words there are to choose from, on a logistic curve.  Labels are of documents only, so
training alternates: in a toxic sample document the worst word stands for the toxic
sentence, all words of the others are clean, and the machine is fitted again, with the clean words that
score highest as further examples.  Since the machine is linear in the kernel,
it folds into one weight for each three characters, and scoring a word is a sum over its
subsequences; every word of every text is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches, decoded, give_back, released
from .workspace import bounded_broadcast, shared_dir

DECAY, SPAN = 0.7, 6
#: Longest stretch of a word scored at once; longer words are scored in overlapping stretches.
STRETCH = 32
#: Labelled documents of each label that the machine is fitted on at most (all learning rows if fewer).
SAMPLE = 5000
LANDMARKS, CLEAN_WORDS, ROUNDS = 192, 6000, 2
#: Words that a document is judged by.
WORST = 3
_LETTERS = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
_SPLIT = re.compile(r"\S+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SINGLES = re.compile(r"(?<!\S)((?:[^\W\d_][ .\-_*]){2,}[^\W\d_])(?!\S)")


def words_of(text: str) -> set[str]:
    """The distinct lower-cased words; letters standing alone one after the other also make a word together."""
    text = text.lower()
    found = {_EDGE.sub("", w) for w in set(_SPLIT.findall(text))}
    found.update("".join(c for c in m[1] if c.isalpha()) for m in _SINGLES.finditer(text))
    long = {w for w in found if len(w) > STRETCH}
    found -= long
    for w in long:
        found.update(w[i : i + STRETCH] for i in range(0, len(w) - STRETCH // 2, STRETCH // 2))
    return {w for w in found if len(w) >= 3}


def _codes(words: list[str]) -> np.ndarray:
    """Characters as small numbers; every word gets a mark at its start, as a character of its own."""
    width = max(map(len, words)) + 1
    out = np.zeros((len(words), width), np.int64)
    out[:, 0] = 63
    for row, w in enumerate(words):
        out[row, 1 : len(w) + 1] = [_LETTERS.get(c) or 27 + ord(c) % 36 for c in w]
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of the three-character subsequences of words; weight 0 beyond a word's end."""
    c = _codes(words)
    width = c.shape[1]
    i, j, k = np.array([(i, j, k) for i in range(width) for j in range(i + 1, width) for k in range(j + 1, min(width, i + SPAN))], np.int64).reshape(-1, 3).T
    codes = c[:, i] << 12 | c[:, j] << 6 | c[:, k]
    weights = np.where(c[:, k] > 0, (DECAY ** (k - i + 1 - 3.0)).astype(np.float32), np.float32(0))
    return codes, weights


def _grouped(words: list[str]) -> Iterator[list[int]]:
    """Indices of words of like length, in lots whose matrices stay small."""
    order = sorted(range(len(words)), key=lambda n: len(words[n]))
    start = 0
    while start < len(order):
        width = len(words[order[start]])
        lot = []
        while start < len(order) and len(words[order[start]]) <= max(width + 1, 5) and len(lot) < 8192:
            lot.append(order[start])
            start += 1
        yield lot


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Norms of rows: equal codes of a row add up.  Codes are sorted together with the number of their weight."""
    kinds, number = np.unique(weights, return_inverse=True)
    both = np.sort(codes.astype(np.int32) * 8 + number.reshape(weights.shape).astype(np.int32), axis=1)
    c, w = both >> 3, kinds[both & 7]
    new = np.ones(c.shape, bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(w.ravel(), starts)
    return np.sqrt(np.bincount(starts // c.shape[1], sums.astype(np.float64) ** 2, minlength=len(c)))


@dataclass
class Model:
    """Weights of three-character subsequences, the bias, and the logistic curve over what is known of a document."""

    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias, np.float64)
        for lot in _grouped(words):
            codes, w = subsequences([words[n] for n in lot])
            norm = _norms(codes, w)
            out[lot] += (self.weights[codes] * w).sum(axis=1) / np.maximum(norm, 1e-9)
        return out

    def features(self, scores: list[float] | np.ndarray) -> list[float]:
        """A document's, from its words' scores: the highest (missing ones are the bias) and the logarithm of their number."""
        worst = nlargest(WORST, scores)
        return [*worst, *[self.bias] * (WORST - len(worst)), math.log1p(len(scores))]

    def probability(self, features: list[list[float]]) -> np.ndarray:
        x = np.array(features, np.float64).reshape(-1, WORST + 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


class Nystrom:
    """Features from the kernel to landmark words."""

    def __init__(self, landmarks: list[str]):
        phi: dict[int, dict[int, float]] = {}
        for n, w in enumerate(landmarks):
            codes, weights = subsequences([w])
            norm = float(_norms(codes, weights)[0]) or 1.0
            for c, x in zip(codes[0].tolist(), weights[0].tolist(), strict=True):
                if x:
                    row = phi.setdefault(c, {})
                    row[n] = row.get(n, 0.0) + x / norm
        self.codes = np.array(sorted(phi), np.int64)
        self.table = np.zeros((len(phi) + 1, len(landmarks)), np.float32)
        for r, c in enumerate(self.codes.tolist()):
            for n, x in phi[c].items():
                self.table[r, n] = x
        self.row = np.full(1 << 18, len(phi), np.int64)
        self.row[self.codes] = np.arange(len(phi))
        values, vectors = np.linalg.eigh(self.kernel(landmarks).astype(np.float64))
        good = values > 1e-6 * values.max()
        self.map = vectors[:, good] / np.sqrt(values[good])

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        for lot in _grouped(words):
            codes, w = subsequences([words[n] for n in lot])
            part = np.zeros((len(lot), self.table.shape[1]), np.float32)
            for t in range(codes.shape[1]):
                part += self.table[self.row[codes[:, t]]] * w[:, t : t + 1]
            out[lot] = part / np.maximum(_norms(codes, w), 1e-9)[:, None]
        return out

    def features(self, words: list[str]) -> np.ndarray:
        return self.kernel(words) @ self.map

    def folded(self, w: np.ndarray) -> np.ndarray:
        """One weight for each three characters, from weights of features."""
        out = np.zeros(1 << 18, np.float64)
        out[self.codes] = self.table[:-1] @ (self.map @ w)
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 4.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-6
    for _ in range(30):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = ridge * w - 2 * c * (x[on] * (weight[on] * y[on] * slack[on])[:, None]).sum(axis=0)
        hess = np.diag(ridge) + 2 * c * (x[on] * weight[on][:, None]).T @ x[on]
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of the columns of ``x`` and a constant, by Newton steps with a small ridge."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _grams(word: str) -> set[str]:
    """The word and its stretches of four characters, its edges marked."""
    p = f"^{word}$"
    return {p[i : i + 4] for i in range(len(p) - 3)} | {word}


def _hashed_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words' grams, where each word's grams start and end)."""
    at = np.zeros(len(words) + 1, np.int64)
    parts = []
    for start in range(0, len(words), 20_000):
        lot = [_grams(w) for w in words[start : start + 20_000]]
        at[start + 1 : start + 1 + len(lot)] = [len(g) for g in lot]
        parts.append(np.fromiter((hash(x) for g in lot for x in g), np.int64, int(at[start + 1 : start + 1 + len(lot)].sum())))
    return np.concatenate(parts or [np.zeros(0, np.int64)]), at.cumsum()


def _first_scores(names: list[str], docs: list[np.ndarray], y: np.ndarray, bad_words: np.ndarray) -> np.ndarray:
    """For each word of toxic documents (ascending in ``bad_words``) its most telling gram; -9 for all others.

    A gram counts by its log odds times the (log) number of toxic documents that hold it.  Only grams of
    toxic documents' words are counted.
    """
    hashes, at = _hashed_grams([names[w] for w in bad_words.tolist()])
    grams, index = np.unique(hashes, return_inverse=True)
    index = index.astype(np.int32)
    del hashes
    held = np.zeros((2, len(grams)), np.int64)
    place = np.full(len(names), -1, np.int32)
    place[bad_words] = np.arange(len(bad_words))
    for lot in range(0, len(docs), 200):
        some = docs[lot : lot + 200]
        # Words that no toxic document holds may still share grams with those of toxic documents.
        others = np.unique(np.concatenate([ws[place[ws] < 0] for ws in some]))
        hashes, start = _hashed_grams([names[w] for w in others.tolist()])
        found = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
        known = grams[found] == hashes
        for ws, t in zip(some, y[lot : lot + 200].astype(int).tolist(), strict=True):
            own = place[ws]
            mine = [index[at[w] : at[w + 1]] for w in own[own >= 0].tolist()]
            for w in np.searchsorted(others, ws[own < 0]).tolist():
                mine.append(found[start[w] : start[w + 1]][known[start[w] : start[w + 1]]])
            if mine:
                held[t][np.unique(np.concatenate(mine))] += 1
    bad, good = int(y.sum()), int(len(y) - y.sum())
    odds = np.log((held[1] + 0.2) / (bad + 1)) - np.log((held[0] + 0.2) / (good + 1))
    score = np.full(len(names), -9.0)
    if len(bad_words):
        score[bad_words] = np.maximum.reduceat((odds * np.log1p(held[1]))[index], at[:-1])
    return score


def fit(names: list[str], docs: list[np.ndarray], toxic: list[int], share: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model from labelled documents; without both labels, or without a word in those of label 1, it gives every text their share.

    ``names`` are the words in ascending order, ``docs`` each document's distinct words as ascending places
    in ``names``; ``share`` is the number of documents that one of label 0 and one of label 1 stands for.
    """
    y = np.array(toxic, np.float64)
    if not len(y) or y.min() == y.max() or not any(len(ws) for ws, t in zip(docs, toxic, strict=True) if t):
        mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.01
        return Model(np.zeros(1 << 18), 0.0, np.array([0.0] * (WORST + 1) + [math.log(mean / (1 - mean))]))
    seen = np.zeros((2, len(names)), np.int64)
    for ws, t in zip(docs, toxic, strict=True):
        seen[t][ws] += 1
    score = _first_scores(names, docs, y, np.flatnonzero(seen[1]))
    every = np.flatnonzero(seen[0])
    clean = every[np.lexsort((every, -seen[0][every]))]
    step = max(1, len(clean) // CLEAN_WORDS)
    clean = np.concatenate((clean[:2000], clean[2000::step])).tolist()
    rare = seen[0] * share[0] <= seen[1] * share[1]
    model = None
    for _ in range(ROUNDS):
        picks: Counter = Counter()
        for ws, t in zip(docs, toxic, strict=True):
            if t and len(ws):
                picks[int(ws[np.flatnonzero(score[ws] == score[ws].max())[-1]])] += 1
        insults = [w for w, _ in picks.most_common()]
        insults = [w for w in insults if rare[w]] or insults
        taken = set(insults)
        common = insults[: LANDMARKS // 2]
        rest = clean[:: max(1, len(clean) // (LANDMARKS - len(common)))][: LANDMARKS - len(common)]
        chart = Nystrom([names[w] for w in dict.fromkeys(common + rest)])
        negatives = [w for w in clean if w not in taken]
        for again in range(2):
            x = chart.features([names[w] for w in insults + negatives])
            target = np.concatenate((np.ones(len(insults)), -np.ones(len(negatives))))
            weight = np.concatenate((np.sqrt([picks[w] for w in insults]), np.ones(len(negatives))))
            w, b = _svm(x, target, weight)
            model = Model(chart.folded(w), b, np.zeros(WORST + 2))
            if not again:  # the clean words it takes for insults, as further examples
                score = _scores(model, names)
                hard = every[np.argsort(-score[every], kind="stable")[:3000]].tolist()
                negatives = list(dict.fromkeys(negatives + [w for w in hard if w not in taken]))
        score = _scores(model, names)
    known = np.array([model.features(score[ws]) for ws in docs])
    model.curve = _logistic(known, y, np.where(y > 0, share[1], share[0]) / max(share))
    return model


def _scores(model: Model, names: list[str]) -> np.ndarray:
    return np.concatenate([model.words(names[n : n + 20_000]) for n in range(0, len(names), 20_000)])


class Scorer:
    """Scores whole texts; remembers words, in two halves of which the older is dropped."""

    MEMO = 200_000

    def __init__(self, model: Model):
        self.model = model
        self.new: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def probability(self, texts: list[bytes]) -> np.ndarray:
        sets = [words_of(decoded(t)) for t in texts]
        if len(self.new) > self.MEMO:
            self.old, self.new = self.new, {}
        lost = [w for w in set().union(*sets) if w not in self.new]
        for w in [w for w in lost if w in self.old]:
            self.new[w] = self.old[w]
        lost = [w for w in lost if w not in self.new]
        self.new.update(zip(lost, self.model.words(lost).tolist(), strict=True))
        get = self.new.__getitem__
        return self.model.probability([self.model.features(list(map(get, s))) for s in sets])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 5) -> Model:
    """Fits on at most ``sample`` documents of each label, of those labelled with ``crc32(doc_id) % fold <> 0``.

    A label's sample is the first in order of a hash of the id, among ids that ``docs`` has; each label counts by its
    documents, not by its sample.  Rows of null id or label teach nothing, and of labels that contradict each
    other for an id the higher counts; of repeated rows of an id one is learnt.  Null and empty texts have no words.  Without rows of
    both labels the model gives every text the same score.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    learn = labels.where("doc_id is not null and toxic in (0, 1)").where(f"crc32(cast(cast(doc_id as bigint) as string)) % {fold} <> 0")
    learn = learn.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    learn = learn.join(docs.select(F.col("doc_id").cast("long").alias("label_id")), "label_id", "left_semi").checkpoint()
    whole = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    first = [learn.where(F.col("toxic") == t).orderBy(F.xxhash64("label_id"), "label_id").limit(sample) for t in (0, 1)]
    taken = first[0].union(first[1]).checkpoint()
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(bounded_broadcast(taken), "label_id").select("label_id", "toxic", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it, "text"):
            yield pa.record_batch([batch.column("label_id"), batch.column("toxic"), pa.array([sorted(words_of(decoded(t))) for t in texts], pa.list_(pa.string()))], names=["id", "toxic", "words"])

    got = rows.mapInArrow(released(run), "id long, toxic int, words array<string>").dropDuplicates(["id"]).toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    toxic = got.column("toxic").to_numpy()[order].tolist()
    # Words become numbers batch by batch: each distinct one is kept once.
    pool: dict[str, int] = {}
    numbered: list[np.ndarray] = []
    for part in got.column("words").chunks:
        coded = part.flatten().dictionary_encode()
        number = np.array([pool.setdefault(w, len(pool)) for w in coded.dictionary.to_pylist()], np.int32)
        every = number[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int32)
        numbered += np.split(every, np.diff(part.offsets.to_numpy()).cumsum()[:-1]) if len(part) else []
    del got
    names = sorted(pool)
    place = np.empty(len(names), np.int32)
    place[[pool[w] for w in names]] = np.arange(len(names), dtype=np.int32)
    del pool
    words = [np.sort(place[numbered[i]]) for i in order.tolist()]
    share = [whole.get(t, 0) / max(1, toxic.count(t)) for t in (0, 1)]
    give_back()  # the sample's Arrow columns go before the machine is fitted, the sample itself after it
    try:
        return fit(names, words, toxic, (share[0], share[1]))
    finally:
        del names, words, numbered
        give_back()


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, score) in the order of ``docs``: the probability that label 1 is right, from the whole text.

    Null and empty texts, and texts without words of three characters, get the score of a document with nothing found.
    Repeated rows get equal scores; an empty table gives an empty result; other columns are ignored, whatever their names.
    Malformed UTF-8 reads as U+FFFD.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch, texts in batches(it, "text"):
            yield pa.record_batch([batch.column("doc_id"), pa.array(scorer.probability(texts))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents whose score reaches ``threshold``; all columns come back, in order.

    Nulls, empty and repeated rows, and other columns are dealt with as in ``score_documents``: rows of equal text stay or go together.
    """
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch, texts in batches(it, batch_text):
            keep = scorer.probability(texts) < threshold
            yield batch.filter(pa.array(keep))

    batch_text = docs.columns[place]
    return docs.mapInArrow(released(run), docs.schema)
