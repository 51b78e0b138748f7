"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Labellers look at a text's words and vote high (1), low (0) or not at all (-1). How often each
combination of votes occurs is counted over all documents; expectation-maximisation on these
counts (at most 3^labellers numbers, however many documents) estimates the share of high
documents and, for each labeller, how it votes on high and on low ones. The posterior of a
document's votes is its label. A logistic scorer over hashed word shapes learns from the
posteriors of a bounded sample (``sample_docs``, chosen by a hash of the id) and then scores
every document from its whole text, also where the labellers abstain.

No table of true labels is used; tests compare with one.

Null texts and texts without words get score 0 and are not kept. With no documents, or votes
that never differ, the scorer keeps what the labellers' prior says. Rows are scored one by
one, so repeated rows get equal results, ids may be null, and other columns are untouched.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm.common import sampled
from failscope.session import ship

#: Frequent words of the languages of the corpus.
STOP_WORDS = frozenset(
    "the of and to in is that it for as with was on be by are this from or an at "
    "le la les de des et un une que qui en du au pour par dans sur est "
    "el los las y del se por con una su para al lo como más "
    "der die das und ist von mit den dem ein eine nicht zu auf für im auch als".split())
LABELLERS = ("repeats", "symbols", "capitals", "columns", "exclaims", "stop_words", "letters",
             "plain")
BUCKETS = 4_096
#: Shorter texts show less: their shares are smoothed by length, clean ones get votes for stop words
#: only, and their score lies between what the label model and what the scorer say.
LEAST_WORDS = 8
CACHED_WORDS = 200_000
_RUN = re.compile(r"([^\W\d_]+)|(\d+)|(.)\3*", re.S)


def shape(word: str) -> str:
    """Letters as A, Aa or a, digits as 9, and up to three of each other character."""

    def part(m: re.Match) -> str:
        letters = m.group(1)
        if letters:
            if letters.islower():
                return "a"
            return "A" if len(letters) > 1 and letters.isupper() else "Aa"
        return "9" if m.group(2) else m.group(0)[:3]

    return _RUN.sub(part, word)[:24]


class WordShapes:
    """Numbers of word kinds: what the labellers and the scorer see of a word."""

    def __init__(self) -> None:
        self.kind: dict[str, int] = {}
        self.numbers: dict[tuple, int] = {}
        self.rows: list[tuple] = []
        self.table = np.empty((0, 8))

    def _learn(self, word: str) -> int:
        form = shape(word)
        letters = sum(map(str.isalpha, word))
        plain = word.lower().rstrip(".,;:")
        bare = form.rstrip(".,;:")
        row = (
            zlib.crc32(form.encode("utf-8", "surrogatepass")) % BUCKETS, min(len(word), 40),
            min(letters, 40), float(plain in STOP_WORDS), float(bare.startswith("A") and "a" not in bare),
            float(word == "|"), float(word.endswith("!!")),
            float(len(form) > 3 and form[-1] == form[-2] == form[-3] and letters > 0))
        at = self.numbers.get(row)
        if at is None:
            at = self.numbers[row] = len(self.rows)
            self.rows.append(row)
        self.kind[word] = at
        return at

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.kind) > CACHED_WORDS:
            self.kind.clear()
        kind, learn = self.kind, self._learn
        found = np.fromiter(
            [k if (k := kind.get(w)) is not None else learn(w) for w in words], np.int64, len(words))
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows)
        return found


def measures(shapes: WordShapes, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes of the labellers, and the hashed features (buckets, weights) of a text."""
    words = text.split()
    n = len(words)
    votes = np.full(len(LABELLERS), -1, np.int8)
    if not n:
        return votes, np.empty(0, np.int64), np.empty(0)
    counts = np.bincount(shapes.of(words), minlength=len(shapes.table))
    used = np.flatnonzero(counts)
    counts, table = counts[used], shapes.table[used]
    repeats = sum(map(operator.eq, words, islice(words, 1, None))) / n
    size, letters, stops, capitals, columns, exclaims, symbols = counts @ table[:, 1:]
    share = letters / size

    # signs of one kind of junk each: a low vote, or none
    signs = ((repeats, 0.05, 0.25), (symbols / n, 0.02, 0.25), (capitals / n, 0.05, 0.5),
             (columns / n, 0.02, 0.2), (exclaims / n, 0.02, 0.25))
    if n >= LEAST_WORDS:
        for i, (value, _, most) in enumerate(signs):
            votes[i] = 0 if value > most else -1
        votes[5] = 1 if stops >= 0.1 * n else 0 if stops < 0.02 * n and n >= 30 else -1
        votes[6] = 1 if share >= 0.85 else 0 if share < 0.7 else -1
        votes[7] = 1 if all(value <= few for value, few, _ in signs) else (
            0 if any(value > most for value, _, most in signs) else -1)
    else:
        weight = n / LEAST_WORDS
        for i, (value, _, most) in enumerate(signs):
            votes[i] = 0 if weight * value > most else -1
        votes[5] = 1 if weight * stops >= 0.1 * n else -1
        votes[6] = 0 if weight * share + (1 - weight) < 0.7 else -1
        votes[7] = 0 if any(vote == 0 for vote in votes[:5]) else -1
    weights = np.bincount(table[:, 0].astype(np.int64), counts, minlength=BUCKETS)
    weights[0] += repeats * n
    buckets = np.flatnonzero(weights)
    values = np.sqrt(weights[buckets] / n)
    return votes, buckets, values


def _pattern(votes: np.ndarray) -> int:
    return int(((votes + 1) * 3 ** np.arange(len(votes))).sum())


def _votes(pattern: int) -> np.ndarray:
    return np.array([pattern // 3**i % 3 - 1 for i in range(len(LABELLERS))])


@dataclass
class WeakLabels:
    """The fitted label model: share of high documents, and vote rates by labeller and class."""

    high: float
    rates: np.ndarray  # labeller x class x vote (abstain, low, high)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of being high for rows of votes."""
        which = np.arange(votes.shape[1])
        logs = np.log(np.array([1 - self.high, self.high]))[None, :] + np.stack(
            [np.log(self.rates[which, c, votes + 1]).sum(axis=1) for c in (0, 1)], axis=1)
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return np.where((votes >= 0).any(axis=1), p[:, 1] / p.sum(axis=1), self.high)

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right when it votes."""
        share = np.array([1 - self.high, self.high])
        right = self.rates[:, 0, 1] * share[0] + self.rates[:, 1, 2] * share[1]
        voted = ((1 - self.rates[:, :, 0]) * share).sum(axis=1)
        return dict(zip(LABELLERS, right / voted))


def fit_labels(patterns: dict[int, int], rounds: int = 100) -> WeakLabels:
    """Expectation-maximisation on counted vote patterns, from any low vote as a start."""
    votes = np.array([_votes(p) for p in patterns]).reshape(-1, len(LABELLERS))
    counts = np.array(list(patterns.values()), float)
    told = (votes >= 0).any(axis=1)  # no votes are no evidence
    votes, counts = votes[told], counts[told]
    if not len(counts):
        return WeakLabels(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    guess = np.where((votes == 0).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        weight = np.stack([(1 - guess) * counts, guess * counts], axis=1)
        rates = np.ones((len(LABELLERS), 2, 3))
        for vote in range(3):
            rates[:, :, vote] += (votes == vote - 1).T @ weight
        rates /= rates.sum(axis=2, keepdims=True)
        high = (weight[:, 1].sum() + 1) / (counts.sum() + 2)
        model = WeakLabels(high, rates)
        new = model.posterior(votes)
        if np.abs(new - guess).max() < 1e-9:
            break
        guess = new
    return model


def _train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, penalty: float = 1e-3,
           rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model for soft targets, by accelerated gradients."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    owner = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    buckets = np.concatenate([b for b, _ in rows]).astype(np.int64)
    values = np.concatenate([v for _, v in rows])
    ahead, ahead_bias, step = weights, bias, 2.0
    for t in range(1, rounds + 1):
        z = np.bincount(owner, values * ahead[buckets], len(rows)) + ahead_bias
        error = 1 / (1 + np.exp(-z)) - target
        slope = np.bincount(buckets, values * error[owner], BUCKETS) / len(rows) + penalty * ahead
        new, new_bias = ahead - step * slope, ahead_bias - step * error.mean()
        pace = (t - 1) / (t + 2)
        ahead, ahead_bias = new + pace * (new - weights), new_bias + pace * (new_bias - bias)
        weights, bias = new, new_bias
    return weights, float(bias)


@dataclass
class QualityModel:
    labels: WeakLabels
    weights: np.ndarray
    bias: float

    def score(self, shapes: WordShapes, text: str) -> tuple[float, int]:
        """Probability of being high by the linear scorer, and the vote pattern."""
        votes, buckets, values = measures(shapes, text)
        if not len(buckets):
            return 0.0, _pattern(votes)
        z = float(values @ self.weights[buckets]) + self.bias
        n = len(text.split(None, LEAST_WORDS))
        if n < LEAST_WORDS:
            told = float(self.labels.posterior(votes[None, :].astype(int))[0])
            told = min(max(told, 1e-6), 1 - 1e-6)
            z = z * n / LEAST_WORDS + float(np.log(told / (1 - told))) * (1 - n / LEAST_WORDS)
        return float(1 / (1 + np.exp(-z))), _pattern(votes)


def fit(docs: DataFrame, sample_docs: int = 4_000) -> QualityModel:
    """Count votes over all documents, fit the label model, train the scorer on a sample."""

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, seen = WordShapes(), Counter()
        for batch in batches:
            seen.update(_pattern(measures(shapes, t)[0])
                        for t in batch.column(0).fill_null("").to_pylist())
        yield pa.RecordBatch.from_pydict(
            {"pattern": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    ship(docs.sparkSession)
    counted = docs.select("text").mapInArrow(patterns, "pattern long, n long").groupBy(
        "pattern").agg(F.sum("n").alias("n"))
    labels = fit_labels({r["pattern"]: r["n"] for r in counted.collect()})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = WordShapes()
        for batch in batches:
            found = [measures(shapes, t) for t in batch.column(0).fill_null("").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "pattern": pa.array([_pattern(v) for v, _, _ in found], pa.int64()),
                "buckets": pa.array([b for _, b, _ in found], pa.list_(pa.int64())),
                "weights": pa.array([w for _, _, w in found], pa.list_(pa.float64()))})

    rows = sampled(docs.select("doc_id", "text"), sample_docs).select("text").mapInArrow(
        features, "pattern long, buckets array<long>, weights array<double>").collect()
    rows = [r for r in rows if r["pattern"]]  # 0: no votes
    target = labels.posterior(np.array([_votes(r["pattern"]) for r in rows]).reshape(
        -1, len(LABELLERS))) if rows else np.empty(0)
    weights, bias = _train(
        [(np.array(r["buckets"], np.int64), np.array(r["weights"])) for r in rows], target)
    return QualityModel(labels, weights, bias)


def _scores(model: QualityModel):
    @F.pandas_udf("score double, pattern long")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shapes = WordShapes()
        for part in texts:
            found = [model.score(shapes, t or "") for t in part.tolist()]
            yield pd.DataFrame(found, columns=["score", "pattern"])

    return score


def quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, posterior, kept) of every document."""
    values = _scores(model)("text")
    scored = docs.select("doc_id", values.alias("s"))
    known = np.arange(3 ** len(LABELLERS))
    high = model.labels.posterior(np.array([_votes(p) for p in known]))

    @F.pandas_udf("double")
    def posterior(pattern: pd.Series) -> pd.Series:
        return pd.Series(high[pattern.to_numpy()])

    return scored.select(
        "doc_id", F.col("s.score").alias("score"), posterior("s.pattern").alias("posterior"),
        (F.col("s.score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    return docs.where(_scores(model)("text")["score"] >= threshold)
