"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are words (runs of letters, their features in lower case); a line's words are one chain, however many they are. Two
states, clean and toxic; a token speaks for a state by its features (word, prefixes of 3 to 6 letters, suffixes of 3
and 4), a pair of neighbours by the transition. Forward-backward gives every token's marginal; tokens over one half that
stand together are an offending span; a logistic function of the marginals' sum and maximum scores the document. Messages
take a step in all chains at once; chains over `PIECE` words are cut for that, and what enters a piece on either side is
carried there by the products of its transfer matrices, so that marginals are those of the whole chain.

Labelled tokens: documents carry the labels, so a token of a toxic document is labelled toxic if one of its features
is; a feature is toxic if documents that have it are labelled toxic so often that chance is ruled out (log-likelihood
ratio over `EVIDENCE`) and at least `PURITY` of them. All other tokens are labelled clean. The field is then fitted to
these tokens by its likelihood's gradient, and the logistic function to documents that took no part in that.

Learning uses a bounded sample: about `PER_LABEL` toxic ids and twice as many clean ones, drawn by a hash of the id, in the order of
that hash for as long as their texts have `CHARS` code points together (whole texts only; each label counts for itself). An id that
repeats counts once, as toxic if any of its labels is, with the first of its texts in code-point order. The field is fitted in
one executor task over the sample; only the model comes to the driver. Scoring reads whole
texts. Null and empty texts, and texts without letters, have no tokens: they get the score of a marginal sum of 0 and no
spans. Without labelled rows of both labels every score is the share of toxic rows (0 without any). Tables may be empty.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweft.llm.common import give_back, held, tidy

#: Documented bounds of the sample: toxic ids, and half the number of clean ones; code points of the texts of each label.
PER_LABEL, CHARS = 1500, 16_000_000
#: Words of a chain that messages pass one after the other.
PIECE = 256
#: When a feature counts as toxic: log-likelihood ratio, and share of toxic documents among those that have it.
EVIDENCE, PURITY = 12.0, 0.8
#: Steps of fitting, penalty on squared weights, words whose weights a worker keeps.
STEPS, PENALTY, KEPT = 50, 1e-6, 150_000
TOKENS = re.compile(r"[^\W\d_]+|\n")
LINE = "\n"


def features(word: str) -> list[str]:
    """Names of a word's features; boundaries are marked, so that a short word is no prefix of itself."""
    word = word.lower()
    return [f"={word}", *[f"^{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n], *[f"{word[-n:]}$" for n in (3, 4) if len(word) > n]]


def pieces(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the pieces of chains from their lengths, in order, and which piece of its chain each is."""
    count = -(-lengths // PIECE)
    chain = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
    return (np.cumsum(lengths) - lengths)[chain] + nth * PIECE, np.minimum(PIECE, lengths[chain] - nth * PIECE), nth


def _entries(x: np.ndarray, a: np.ndarray, starts: np.ndarray, sizes: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the forward ratio that its chain brings from before it, and the backward ratio at its last token.

    The first is only meaningful where nth > 0; the second is 1 at a chain's end.
    """
    before, behind = np.ones(len(starts)), np.ones(len(starts))
    last = np.append(nth[1:] == 0, True)
    long = np.flatnonzero((nth > 0) | ~last)  # pieces of chains of more than one
    if not len(long):
        return before, behind
    order = long[np.argsort(-sizes[long], kind="stable")]
    product = np.tile(np.eye(2), (len(order), 1, 1))
    going = np.searchsorted(-sizes[order], -np.arange(1, int(sizes[order[0]]) + 1), side="right")
    for t, n in enumerate(going):
        own = x[starts[order[:n]] + t]
        step = np.empty((n, 2, 2))
        step[:, :, 0], step[:, :, 1] = a[:, 0], a[:, 1] * own[:, None]
        if t == 0:  # no transition leads into the first token of a chain
            step[nth[order[:n]] == 0] = np.eye(2)
            step[nth[order[:n]] == 0, 1, 1] = own[nth[order[:n]] == 0]
        done = product[:n] @ step
        product[:n] = done / done.max((1, 2), keepdims=True)
    transfer = dict(zip(order.tolist(), product, strict=True))
    for i in long.tolist():  # one step a piece, from the left and then from the right
        if not last[i]:
            v = np.array([1.0, before[i] if nth[i] else 1.0]) @ transfer[i]
            before[i + 1] = v[1] / max(v[0], 1e-300)
    for i in reversed(long.tolist()):
        if nth[i]:
            u = transfer[i] @ np.array([1.0, behind[i]])
            behind[i - 1] = u[1] / max(u[0], 1e-300)
    return before, behind


def marginals(speak: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state for each token, from its log potential and the 2 by 2 log transitions.

    With two states, each message of forward-backward is one ratio (toxic to clean). All pieces take a step at once: they
    are sorted by length and their tokens laid out by step, so that those which go on are a prefix of the step before.
    With `pairs` also the expected transitions.
    """
    a = np.exp(moves)
    x = np.exp(np.clip(speak, -30, 30), dtype=np.float64)
    starts, sizes, nth = pieces(lengths)
    before, behind = _entries(x, a, starts, sizes, nth)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, opens, before, behind = starts[order], sizes[order], nth[order] == 0, before[order], behind[order]
    steps = int(sizes[0]) if len(sizes) else 0
    going = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right").tolist()
    at = np.concatenate([[0], np.cumsum(going)]).astype(np.int64).tolist()
    place = np.concatenate([starts[:n] + t for t, n in enumerate(going)]) if steps else np.empty(0, np.int64)
    x = x[place]
    forward, backward = np.empty_like(x), np.empty_like(x)
    came = before
    for t, n in enumerate(going):
        own = x[at[t] : at[t + 1]]
        came = own * (a[0, 1] + came[:n] * a[1, 1]) / (a[0, 0] + came[:n] * a[1, 0])
        if t == 0:
            came = np.where(opens, own, came)
        forward[at[t] : at[t + 1]] = came
    expected, ahead = np.zeros((2, 2)), np.empty(0)
    for t in range(steps - 1, -1, -1):
        n, on = going[t], len(ahead)
        backward[at[t] : at[t] + on] = (a[1, 0] + a[1, 1] * ahead) / (a[0, 0] + a[0, 1] * ahead)
        backward[at[t] + on : at[t + 1]] = behind[on:n]
        ahead = x[at[t] : at[t + 1]] * backward[at[t] : at[t + 1]]
        if pairs:
            last, now = (forward[at[t - 1] : at[t - 1] + n], ahead) if t else (before[~opens], ahead[~opens])
            joint = [a[0, 0], a[0, 1] * now, last * a[1, 0], last * now * a[1, 1]]
            total = joint[0] + joint[1] + joint[2] + joint[3]
            expected += np.array([(j / total).sum() for j in joint]).reshape(2, 2)
    forward *= backward
    out = np.empty_like(forward)
    out[place] = forward / (1 + forward)
    return out, expected


def lines_of(text: str | None) -> tuple[list[str], list[int]]:
    """Words of a text as they stand in it, and how many each line has."""
    words: list[str] = []
    lengths = []
    for line in (text or "").split(LINE):
        found = TOKENS.findall(line)
        if found:
            words += found
            lengths.append(len(found))
    return words, lengths


@dataclass
class Model:
    """Weights by feature, log transitions, and the logistic function of (sum, maximum) of the marginals."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: tuple[float, float, float] = (0.0, 0.0, 0.0)  # intercept, of log(1 + sum), of maximum
    fallback: float | None = None

    def speak(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def score(self, total: float, most: float) -> float:
        if self.fallback is not None:
            return self.fallback
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale[0] + self.scale[1] * math.log1p(total) + self.scale[2] * most))))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def texts(self, texts: list[str | None], spans: bool) -> list[tuple[float, list[dict[str, int]]]]:
        split = [lines_of(t) for t in texts]
        known, speak = self.known, self.model.speak
        if len(known) > KEPT:
            known.clear()
        for words, _ in split:
            for w in set(words).difference(known):
                known[w] = speak(w)
        lengths = np.array([n for _, ns in split for n in ns], np.int64)
        sizes = [len(words) for words, _ in split]
        potentials = np.fromiter((known[w] for words, _ in split for w in words), np.float64, sum(sizes))
        p, _ = marginals(potentials, lengths, self.model.moves)
        out, at = [], 0
        for text, n in zip(texts, sizes, strict=True):
            own = p[at : at + n]
            at += n
            found = self.offsets(text, own) if spans and n and own.max() > 0.5 else []
            out.append((self.model.score(float(own.sum()), float(own.max()) if n else 0.0), found))
        return out

    @staticmethod
    def offsets(text: str, p: np.ndarray) -> list[dict[str, int]]:
        """Code-point spans [start, stop) of neighbouring tokens over one half; none crosses a line."""
        found: list[dict[str, int]] = []
        k, joined = 0, False
        for m in TOKENS.finditer(text):
            if m[0] == LINE:
                joined = False
                continue
            hot = k < len(p) and p[k] > 0.5
            k += 1
            if hot and joined:
                found[-1]["stop"] = m.end()
            elif hot:
                found.append({"start": m.start(), "stop": m.end()})
            joined = hot
        return found


class _Corpus:
    """Sampled texts as numbers: word ids and line lengths of each text, and the feature ids of each word (as one array)."""

    def __init__(self, texts: Iterable[str | None], mark: list[int]):
        """Only features that a text with a mark has can turn out toxic; words keep those alone, which bounds the tables."""
        vocabulary: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.lines: list[np.ndarray] = []
        for t in texts:  # a generator: one text's words at a time
            words, lengths = lines_of(t)
            self.words.append(np.fromiter((vocabulary.setdefault(w.lower(), len(vocabulary)) for w in words), np.int32, len(words)))
            self.lines.append(np.array(lengths, np.int64))
        index: dict[str, int] = {}
        marked = np.zeros(len(vocabulary), bool)
        for words, m in zip(self.words, mark, strict=True):
            if m:
                marked[words] = True
        for w, m in zip(vocabulary, marked, strict=True):
            if m:
                for f in features(w):
                    index.setdefault(f, len(index))
        self.count = np.zeros(len(vocabulary), np.int64)
        chosen = array("i")
        for k, w in enumerate(vocabulary):
            own = [index[f] for f in features(w) if f in index]
            self.count[k] = len(own)
            chosen.extend(own)
        self.start = np.cumsum(self.count) - self.count
        self.feature = np.frombuffer(chosen, np.int32)
        self.names = list(index)

    def features_of(self, words: np.ndarray) -> np.ndarray:
        """Feature ids of some words, one after the other."""
        n = self.count[words]
        return self.feature[np.repeat(self.start[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _toxic_features(corpus: _Corpus, learn: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each feature, whether toxic documents have it far more often than chance allows."""
    have, bad = np.zeros(len(corpus.names)), np.zeros(len(corpus.names))
    for i in learn:
        own = np.unique(corpus.features_of(np.unique(corpus.words[i])))
        have[own] += 1
        bad[own] += toxic[i]
    share = float(toxic[learn].mean())
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda c, q: np.where(c > 0, c * np.log(q), 0.0)
        ratio = 2 * (part(bad, bad / have / share) + part(have - bad, (have - bad) / have / (1 - share)))
        return (bad >= 2) & (bad >= PURITY * have) & (ratio >= EVIDENCE)


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """A model from (text, label) rows; every third row is kept out of the field and fits the logistic function."""
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(fallback=float(y.mean()) if len(y) else 0.0)
    corpus = _Corpus((t for t, _ in rows), [label for _, label in rows])
    kept_out = np.zeros(len(rows), bool)
    for label in (0, 1):
        kept_out[np.nonzero(y == label)[0][2::3]] = True
    learn = np.nonzero(~kept_out)[0]
    model = Model()
    if len(set(y[learn])) == 2 and (toxic := _toxic_features(corpus, learn, y)).any():
        _fit_field(model, corpus, learn, y, toxic)
    use = np.nonzero(kept_out)[0] if len(set(y[kept_out])) == 2 else np.arange(len(rows))
    weight = np.array([model.weights.get(f, 0.0) for f in corpus.names])
    speak = model.bias + np.bincount(np.repeat(np.arange(len(corpus.count)), corpus.count), weight[corpus.feature], len(corpus.count))
    stats = []
    for i in use:
        p, _ = marginals(speak[corpus.words[i]], corpus.lines[i], model.moves)
        stats.append((math.log1p(p.sum()), p.max() if len(p) else 0.0))
    model.scale = _logistic(np.array(stats), y[use])
    return model


def _fit_field(model: Model, corpus: _Corpus, learn: np.ndarray, y: np.ndarray, toxic: np.ndarray) -> None:
    """Gradient steps (with per-weight step sizes) on the log likelihood of the labelled tokens."""
    token = np.concatenate([corpus.words[i] for i in learn])  # 32-bit numbers
    lengths = np.concatenate([corpus.lines[i] for i in learn])
    n_words, owner, feature = len(corpus.count), np.repeat(np.arange(len(corpus.count)), corpus.count), corpus.feature
    seldom = (np.bincount(feature, minlength=len(toxic)) < 2) & ~toxic  # names of one word only say what the word says
    is_toxic = np.bincount(owner, toxic[feature], n_words) > 0
    label = is_toxic[token] * np.repeat(y[learn], [len(corpus.words[i]) for i in learn])
    observed = np.zeros((2, 2))
    first = np.zeros(len(token), bool)
    first[np.cumsum(lengths) - lengths] = True
    later = np.nonzero(~first)[0]
    np.add.at(observed, (label[later - 1].astype(int), label[later].astype(int)), 1)
    weight, bias, moves = np.zeros(len(toxic)), -4.0, np.zeros((2, 2))
    seen = [np.full(len(toxic), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    for _ in range(STEPS):
        per_word = bias + np.bincount(owner, weight[feature], n_words)
        p, expected = marginals(per_word[token], lengths, moves, pairs=True)
        short = np.bincount(token, label - p, n_words)
        gradient = [np.where(seldom, 0.0, np.bincount(feature, short[owner], len(toxic)) - PENALTY * weight * len(token)), float(short.sum()), observed - expected]
        seen = [s + g * g for s, g in zip(seen, gradient, strict=True)]
        weight = weight + gradient[0] / np.sqrt(seen[0])
        bias += 0.5 * gradient[1] / math.sqrt(seen[1])
        moves = moves + 0.2 * gradient[2] / np.sqrt(seen[2])
    model.weights = {corpus.names[k]: float(weight[k]) for k in np.nonzero(np.abs(weight) > 1e-3)[0]}
    model.bias, model.moves = float(bias), moves


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Penalised logistic regression by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.02, 0.02])
        beta = beta + np.linalg.solve(hessian, design.T @ (y - p) - np.array([1e-6, 0.02, 0.02]) * beta)
    return float(beta[0]), float(beta[1]), float(beta[2])


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, chars: int = CHARS) -> Model:
    """A model from texts (doc_id, text) and labels (doc_id, toxic).

    The sample is drawn from the slim labels, so that only its ids, which are bounded, meet the texts. Labels other than
    0 and 1, and labels whose id has no text, play no part.
    """
    known = labels.select("doc_id", "toxic").filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    shares = {r.toxic: (2 - r.toxic) * per_label * (1 << 20) / r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    drawn = known.filter(F.when(F.col("toxic") == 1, F.col("_h") < shares.get(1, 0.0)).otherwise(F.col("_h") < shares.get(0, 0.0)))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "_h", "toxic").agg(F.min("text").alias("text"))  # about 3 per_label ids

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, left = [], {0: chars, 1: chars}
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                if left[label] >= 0:
                    left[label] -= len(text or "")
                    found.append((text, label))
        model = pickle.dumps(fit(found))
        del found
        give_back()
        yield pd.DataFrame({"model": [model]})

    made = rows.repartition(1).sortWithinPartitions("_h", "doc_id").select("text", "toxic").mapInPandas(fitted, "model binary").first()
    tidy(docs.sparkSession)
    return pickle.loads(made.model) if made else Model(fallback=0.0)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity", spans: bool = True) -> DataFrame:
    """`docs` with a struct `name` (in place of a column of that name, if there is one).

    Its fields: score (0 to 1) and spans, array<struct<start,stop>> in code points (empty where `spans` is not asked for).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = uuid.uuid4().hex

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = held(mark, lambda: Scorer(shared.value))
        for texts in batches:
            rows = []
            for i in range(0, len(texts), 200):
                rows += scorer.texts(list(texts.iloc[i : i + 200]), spans)
            yield pd.DataFrame({"score": [r[0] for r in rows], "spans": [r[1] for r in rows]})
        give_back()

    scored_udf = F.pandas_udf(scored, "score double, spans array<struct<start:int,stop:int>>", F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn(name, scored_udf(F.col(text)))
