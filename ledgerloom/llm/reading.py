"""Reading level of each document from n-gram surprisal.

1. A text is cut into running sentences (``sentences``): hard-wrapped lines are joined, item listings,
   form headers and totals are set aside. Documents that are mainly listing, or blank, have no level.
2. For every level of the scale an interpolated trigram model (trigram, bigram, unigram, uniform) is
   trained on the sentences of rated documents, at most ``MAX_RATED`` of them (those with the least
   hash of their id; the bound of the training sample). As a document mixes easy and hard sentences,
   expectation-maximisation shares each training sentence out over the levels: its weight in a
   level's model is its posterior under the models, held near the document's rating.
3. Every sentence of every document, whole texts, is scored under all models. The differences in
   surprisal give the sentence's level distribution; the document's is their mean by length.
4. Isotonic regression (pool adjacent violators) maps the document's expected level to the raters'
   scale without ever turning a more demanding document into a plainer one. It is fitted on scores
   that models trained on the other half of the rated documents gave.

The models are a few arrays of n-gram weights that go to the workers; scoring is map-only, runs over the
tokens of many sentences at once, and moves no text. Defined results: null, blank and unrated-form texts give no row; unknown words are equally
surprising to all models and decide nothing; several ratings of one document count as their median;
without any rated document there is no result; ties between levels go to the plainer one; repeated
document ids are separate documents.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import widen

#: Bound of the training sample, in rated documents.
MAX_RATED = 1_500

#: Shares of trigram, bigram, unigram and uniform model; rounds of expectation-maximisation.
LAMBDA, EM_ROUNDS = (0.45, 0.33, 0.20, 0.02), 4

#: Prior weight of a sentence's level by its distance from the document's rating.
SPREAD = (1.0, 0.35, 0.12, 0.04, 0.02)

#: A document is running text if its sentences hold so many words and such a share of all its words.
MIN_WORDS, MIN_SHARE = 4, 0.25

#: Sentences whose distribution a worker remembers: forms and phrases recur.
CACHE = 200_000

#: Documents that a worker scores at once.
DOCUMENTS = 1_000

_HEADER = re.compile(
    r"^\s*(?:tax invoice|invoice|proforma.*|statement of account|delivery (?:note|challan)|credit note|debit note|purchase order|packing list|receipt|rechnung|facture|lieferschein"
    r"|(?:invoice|bill|order|po|gstin|tax|date|page|ref|no|rechnung|facture)\b[^.!?]{0,20}[:#].*|(?:sl|sr|s|nr|pos|no)\b\.?\s*(?:no\.?)?\s*(?:description|beschreibung|item|artikel|particulars|d[ée]signation).*"
    r"|(?:sub\s?total|total|grand total|taxable.*|cgst|sgst|igst|round off|summe|gesamt|montant)\b[^a-z]*[\d.,]+.*)\s*$",
    re.I,
)
_ITEM = re.compile(r"^\s*(?:[-*•]\s*)?(?:\d+[.)]?\s+|\|).*\d|^\s*\S.*\|.*\d|^\s*.{3,60}?\s+\d+(?:[.,]\d+)?\s+\d+[.,]\d{2}\s+\d+[.,]\d{2}\s*$")
_NUMBERS = re.compile(r"\d+(?:[.,]\d{2})\b")
_WORDS = re.compile(r"[^\W\d_]{2,}")
_ENDED = re.compile(r"[.!?]\s*$")
_BOUNDARY = re.compile(r"(?<=[.!?])\s+|(?<=[a-zäöüéèàß]:)\s+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d[\d.,]*")


def _listing(line: str) -> bool:
    if _HEADER.match(line):
        return True
    if len(_NUMBERS.findall(line)) < 2 or not _ITEM.match(line) or len(_WORDS.findall(line)) > 12:
        return False
    return not _ENDED.search(line.strip() if not line.strip()[-1:].isdigit() else "")


def split(text: object) -> tuple[list[str], int]:
    """(running sentences as written, words in listings)."""
    if not isinstance(text, str):
        return [], 0
    keep, listed = [], 0
    for line in text.splitlines():
        if line and not line.isspace() and _listing(line):
            listed += len(line.split())
            keep.append("\n")
        else:
            keep.append(line + " ")
    return [s for block in "".join(keep).split("\n") for s in _BOUNDARY.split(block)], listed


def tokens(sentence: str) -> list[str]:
    return ["#" if x[0].isdigit() else x for x in _TOKEN.findall(sentence.lower())]


def sentences(text: object) -> tuple[list[list[str]], int, int]:
    """(tokens of every running sentence, words in sentences, words in listings)."""
    raw, listed = split(text)
    out = [t for t in map(tokens, raw) if t]
    return out, sum(map(len, out)), listed


def is_running(text: object) -> bool:
    sents, words, listed = sentences(text)
    return _running(words, listed, any(len(t) >= 3 for t in sents))


def _running(words: int, listed: int, any_sentence: bool) -> bool:
    # Words in forms like "n/a" are no sentence; a text without any sentence of three words is none.
    return any_sentence and words >= MIN_WORDS and words >= MIN_SHARE * (words + listed)


class Grams:
    """The tokens of many sentences as numbers: 0 is a word that no model knows, 1 the start of a sentence."""

    def __init__(self, sents: list[list[str]], vocabulary: dict[str, int]):
        n = np.array([len(t) for t in sents], dtype=np.int64)
        get = vocabulary.get
        self.sent = np.repeat(np.arange(len(sents)), n)
        self.w = np.fromiter((get(x, 0) for t in sents for x in t), np.int64, int(n.sum()))
        start = np.zeros(len(self.w), np.int64)
        first = np.cumsum(n) - n
        start[first[n > 0]] = 1
        self.v, self.u = np.ones_like(self.w), np.ones_like(self.w)
        self.v[1:] = np.where(start[1:] == 1, 1, self.w[:-1])
        self.u[2:] = np.where((start[2:] == 1) | (start[1:-1] == 1), 1, self.w[:-2])
        self.n = n


class LevelModels:
    """Interpolated trigram models of all levels over one vocabulary; n-grams are sorted numbers, their weights rows."""

    def __init__(self, levels: list[int], vocabulary: dict[str, int]):
        self.levels, self.vocabulary, self.size = levels, vocabulary, len(vocabulary) + 2
        if self.size >= 1 << 21:
            raise ValueError("vocabulary of the training sample is too large for three words in one number")

    def _keys(self, g: Grams) -> tuple[np.ndarray, np.ndarray]:
        return g.v * self.size + g.w, (g.u * self.size + g.v) * self.size + g.w

    def fit(self, g: Grams, weight: np.ndarray) -> LevelModels:
        """From the share of every level in each sentence (sentences x levels)."""
        levels = range(len(self.levels))
        w = weight[g.sent]
        total = lambda at, n: np.stack([np.bincount(at, w[:, k], minlength=n) for k in levels], axis=1)
        two, three = self._keys(g)
        c1 = total(g.w, self.size)
        floor = LAMBDA[3] / (len(self.vocabulary) + 1)
        self.p1 = np.where(c1.sum(axis=1, keepdims=True) > 0, floor + LAMBDA[2] * c1 / np.maximum(c1.sum(axis=0), 1e-9), floor)
        self.k2, at2 = np.unique(two, return_inverse=True)
        self.k3, at3 = np.unique(three, return_inverse=True)
        before = total(g.v, self.size)
        pair, at_pair = np.unique(three // self.size, return_inverse=True)
        context = total(at_pair, len(pair))
        # A last row of zeros for n-grams that were not seen.
        none = np.zeros((1, len(self.levels)))
        self.p2 = np.vstack([LAMBDA[1] * total(at2, len(self.k2)) / (before[self.k2 // self.size] + 0.5), none])
        self.p3 = np.vstack([LAMBDA[0] * total(at3, len(self.k3)) / (context[np.searchsorted(pair, self.k3 // self.size)] + 0.5), none])
        return self

    def surprisal(self, g: Grams) -> np.ndarray:
        """Total surprisal (nats) of every sentence under every level's model."""
        out = np.zeros((len(g.n), len(self.levels)))
        if len(g.w):
            likely = self.p1[g.w].copy()
            for keys, known, p in zip(self._keys(g), (self.k2, self.k3), (self.p2, self.p3)):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                likely += p[np.where((known[at] == keys) & (g.w > 0), at, len(known))]
            filled = g.n > 0
            out[filled] = np.add.reduceat(-np.log(likely), (np.cumsum(g.n) - g.n)[filled])
        return out

    def posterior(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(level distribution, surprisal) of every sentence."""
        s = self.surprisal(Grams(sents, self.vocabulary))
        e = np.exp(s.min(axis=1, keepdims=True) - s)
        return e / e.sum(axis=1, keepdims=True), s


def document_levels(models: LevelModels, texts: list, known: dict | None = None) -> list[tuple[list[float], list[float]] | None]:
    """(mean level distribution of the sentences by length, mean surprisal of a token) of every document, None for a text that is not running.

    ``known`` remembers sentences by how they are written: (words, distribution, surprisal).
    """
    known = {} if known is None else known
    parts = [split(t) for t in texts]
    fresh = list(dict.fromkeys(s for raw, _ in parts for s in raw if s not in known))
    cut = [tokens(s) for s in fresh]
    p, x = models.posterior(cut)
    here = {s: (len(t), a, b) for s, t, a, b in zip(fresh, cut, p, x)}
    n_docs, levels = len(texts), len(models.levels)
    seen = [here.get(s) or known[s] for raw, _ in parts for s in raw]
    doc = np.repeat(np.arange(n_docs), [len(raw) for raw, _ in parts])
    n = np.array([a for a, _, _ in seen], dtype=float)
    long = n >= 3
    words = np.bincount(doc, n, minlength=n_docs)
    total = np.bincount(doc, n * long, minlength=n_docs)
    mix, nats = np.zeros((n_docs, levels)), np.zeros((n_docs, levels))
    if len(seen):
        dist, cost = np.stack([b for _, b, _ in seen]), np.stack([c for _, _, c in seen])
        for k in range(levels):
            mix[:, k] = np.bincount(doc, dist[:, k] * n * long, minlength=n_docs)
            nats[:, k] = np.bincount(doc, cost[:, k] * long, minlength=n_docs)
    if len(known) < CACHE:
        known.update(here)
    return [((mix[i] / total[i]).tolist(), (nats[i] / total[i]).tolist()) if _running(words[i], parts[i][1], total[i] > 0) else None for i in range(n_docs)]


def train(rated: list[tuple[str, int]], levels: list[int] | None = None) -> LevelModels:
    """Models of the levels from (text, rating) of rated documents."""
    levels = levels or sorted({r for _, r in rated})
    sents, ratings = [], []
    for text, r in rated:
        own = [t for t in sentences(text)[0] if len(t) >= 3]
        sents += own
        ratings += [r] * len(own)
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in sents for w in t}), 2)}
    g = Grams(sents, vocabulary)
    prior = np.array([[SPREAD[min(abs(k - r), len(SPREAD) - 1)] for k in levels] for r in ratings]).reshape(len(sents), len(levels))
    weight = prior / prior.sum(axis=1, keepdims=True)
    models = LevelModels(levels, vocabulary)
    for turn in range(EM_ROUNDS):
        if turn:
            s = models.surprisal(g)
            weight = np.exp((s.min(axis=1, keepdims=True) - s) / np.maximum(1.0, g.n / 12)[:, None]) * prior
            weight /= weight.sum(axis=1, keepdims=True)
        models.fit(g, weight)
    return models


def isotonic(x: list[float], y: list[float]) -> tuple[list[float], list[float]]:
    """Least-squares non-decreasing fit by pooling adjacent violators: block starts and values."""
    blocks: list[list[float]] = []
    for a, b in sorted(zip(x, y)):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] > blocks[-1][1]:
            s, v, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], (blocks[-1][1] * blocks[-1][2] + v * n) / (blocks[-1][2] + n), blocks[-1][2] + n]
    return [b[0] for b in blocks], [b[1] for b in blocks]


def apply_isotonic(curve: tuple[list[float], list[float]], x: float) -> float:
    """Value of the fitted curve, linear between the starts of its blocks."""
    xs, ys = curve
    lo, hi = 0, len(xs)
    while lo < hi:
        mid = (lo + hi) // 2
        if xs[mid] <= x:
            lo = mid + 1
        else:
            hi = mid
    return ys[max(lo - 1, 0)]


def expected(levels: list[int], mix: list[float]) -> float:
    return sum(k * p for k, p in zip(levels, mix))


def rated_sample(documents: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """(text, rating) of at most ``MAX_RATED`` rated documents, those with the least hash of their id."""
    one = labels.where(F.col("reading_level").isNotNull()).groupBy("doc_id").agg(F.floor(F.median("reading_level") + 0.5).cast("int").alias("rating"))
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_RATED)
    rows = documents.join(F.broadcast(few), "doc_id").where(F.col("text").isNotNull()).select("doc_id", "text", "rating").orderBy("doc_id").collect()
    return [(r.text, r.rating) for r in rows if is_running(r.text)]


def held_out_scores(rated: list[tuple[str, int]], levels: list[int]) -> list[tuple[float, float]]:
    """(expected level, rating) of every rated document by models that were trained on the other half of them."""
    out, mixed = [], list(rated)
    random.Random(42).shuffle(mixed)  # ids may tell the levels apart
    for part in (0, 1):
        mine, others = mixed[part::2], mixed[1 - part :: 2]
        if mine and others:
            models = train(others, levels)
            out += [(expected(levels, m[0]), float(r)) for m, (_, r) in zip(document_levels(models, [t for t, _ in mine]), mine) if m]
    return out


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level, score, distribution, surprisal) of every document that is mainly running text.

    ``score`` is the expected level before the isotonic map, ``distribution`` the level distribution it comes from,
    ``surprisal`` the mean surprisal of a token under the model of each level.
    """
    spark = documents.sparkSession
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, reading_level int, score double, distribution array<double>, surprisal array<double>"
    rated = rated_sample(documents, labels)
    if not rated:
        return spark.createDataFrame([], schema)
    models = train(rated)
    scores = held_out_scores(rated, models.levels) or [(float(r), float(r)) for _, r in rated]
    curve = isotonic([x for x, _ in scores], [y for _, y in scores])
    sent = spark.sparkContext.broadcast((models, curve))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, curve = sent.value
        known: dict = {}
        for pdf in batches:
            for at in range(0, len(pdf), DOCUMENTS):
                some = pdf.iloc[at : at + DOCUMENTS]
                out = []
                for i, got in zip(some["doc_id"], document_levels(models, list(some["text"]), known)):
                    if got is not None:
                        x = expected(models.levels, got[0])
                        level = math.ceil(apply_isotonic(curve, x) - 0.5)
                        out.append((i, min(max(level, models.levels[0]), models.levels[-1]), x, *got))
                yield pd.DataFrame(out, columns=["doc_id", "reading_level", "score", "distribution", "surprisal"])

    return widen(documents.select("doc_id", "text")).mapInPandas(run, schema)
