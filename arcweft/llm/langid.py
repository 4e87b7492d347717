"""Language ID by interpolated Kneser-Ney character models, one per language.

Characters are predicted within words: a text's words (runs of letters, lower case, cut at `LONGEST`) stand between spaces,
and a character is predicted from up to `ORDER - 1` characters before it in its word. Counts come from a bounded sample of
labelled rows (of each language about `per_language` rows or `CHARS` code points, whichever is less, drawn by a hash of id and text; rows
of a language that repeat a text count once); they are gathered by a group-by and smoothed in one executor task, of which only the model comes to the driver.

A model holds, for each order, the hashes of the n-grams that any language has, sorted, and beside them per language the
interpolated log probability of the last character and the log weight that the n-gram, as a context, hands down. Scoring
is a binary search per character and order; words repeat, so their sums are kept in a table of bounded size.

The language of a text is the one of least cross-entropy per character. On sampled rows kept out of the counts, the
excess over the language's usual cross-entropy (times the root of the length, up to `STEADY` characters) is measured;
a text is rejected if its excess is over the calibrated bound. A language with fewer than `CALIBRATED` such rows is
cross-validated on all of its sampled rows instead; if too few are told apart from other languages for a bound, it takes
the bound of all languages, and with none also their usual cross-entropy. With no such row in any language, what is
predicted no better than by guessing among the letters is rejected. `score` is the share of the language's likelihood among all
languages and the rejecting one, over at most `STEADY` characters.

Texts without any letter, empty and null texts are `und` with score 0 and rejected. Ties go to the language that sorts
first. Without any labelled row every text is `und`. Other columns are handed through; ids may repeat or be null.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweft.llm.common import cut, give_back, held, tidy

#: n-gram order, longest stretch of letters taken as one word, characters from which on length adds no certainty.
ORDER, LONGEST, STEADY = 5, 40, 60
#: Labelled rows and code points of each language that the model is made from: documented bounds on the sample, not on what is scored.
PER_LANGUAGE, CHARS = 500, 4_000_000
#: Rows kept out of the counts that a language's own bound takes at least; parts of a cross-validation.
CALIBRATED, FOLDS = 5, 10
#: Words whose sums a worker keeps.
KEPT = 150_000
WORDS = re.compile(r"[^\W\d_]{1,%d}" % LONGEST).findall
UNDETERMINED = "und"


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, chars: int = CHARS) -> DataFrame:
    """(lang, text, calibrate): about `per_language` rows or `chars` code points of each language, all rows if that is less.

    A row is drawn if the hash of its id and text lies under the language's share; a fifth of them is for calibration.
    """
    rows = labelled.filter("lang is not null and text is not null")
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars")).collect()  # a row a language
    shares = {r.lang: min(per_language / r.n, chars / max(r.chars, 1)) * (1 << 20) for r in found}
    if not shares:
        return rows.select("lang", "text", F.lit(False).alias("calibrate"))
    under = F.create_map(*[F.lit(x) for item in sorted(shares.items()) for x in item])[F.col("lang")]
    drawn = rows.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)).alias("_h")).filter(F.col("_h") < under)
    return drawn.groupBy("lang", "text").agg(F.min("_h").alias("_h")).select("lang", "text", (F.col("_h") % 5 == 0).alias("calibrate"))


def _counted(words: Counter[str]) -> Counter[str]:
    grams: Counter[str] = Counter()
    for word, n in words.items():
        padded = f" {word} "
        for end in range(2, len(padded) + 1):
            for start in range(max(0, end - ORDER), end):
                grams[padded[start:end]] += n
    return grams


def _ngrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            words: Counter[str] = Counter()
            for t in texts:
                words.update(WORDS(t.lower()))
            grams = _counted(words)
            yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to `order`, the hash of the n characters that end at each place (as if unbounded by words)."""
    out = [(codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)]
    for n in range(1, order):
        earlier = np.zeros_like(out[0])
        earlier[n:] = out[0][:-n] if n < len(codes) else earlier[n:]
        mixed = (out[-1] ^ (out[-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(mixed + earlier)
    return out


@dataclass
class Model:
    """Sorted hashes per order; log probabilities and back-off log weights, one column a language."""

    langs: list[str]
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    weight: list[np.ndarray]
    floor: np.ndarray
    usual: np.ndarray
    bound: np.ndarray

    def score_words(self, words: list[str]) -> np.ndarray:
        """Sum of log probabilities per language and, in the last column, the number of characters, for each word."""
        text = " " + "  ".join(words) + " "
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        at = np.arange(len(codes)) - np.repeat(starts, lengths)
        places = np.nonzero(at > 0)[0]
        depth = at[places] + 1  # characters of the word up to here
        logp = np.tile(self.floor, (len(places), 1))
        found_before = np.full(len(codes), -1)
        for n, hashed in enumerate(_hashes(codes, ORDER), 1):
            table = self.hashes[n - 1]
            index = np.full(len(codes), -1)
            if len(table):
                within = np.nonzero(at + 1 >= n)[0]
                spot = np.minimum(np.searchsorted(table, hashed[within]), len(table) - 1)
                index[within] = np.where(table[spot] == hashed[within], spot, -1)
            here = index[places]
            seen = here >= 0
            if n > 1:  # handed down through the context, if that is known; what is seen has its own value
                context = np.where(depth >= n, found_before[places - 1], -1)
                known = (context >= 0) & ~seen
                logp[known] += self.weight[n - 2][context[known]]
            logp[seen] = self.logp[n - 1][here[seen]]
            found_before = index
        owner = np.repeat(np.arange(len(words)), lengths)[places]
        out = np.empty((len(words), len(self.langs) + 1))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, logp[:, k], len(words))
        out[:, -1] = lengths - 1
        return out

    def judge(self, sums: np.ndarray) -> tuple[str, float, bool, float, int]:
        """Language, score, rejected, excess and characters of a text from the sums over its words."""
        n = sums[-1]
        if not n or not self.langs:
            return UNDETERMINED, 0.0, True, 0.0, 0
        entropy = -sums[:-1] / n
        best = int(np.argmin(entropy))
        steady = math.sqrt(min(n, STEADY))
        excess = (entropy[best] - self.usual[best]) * steady
        limit = self.usual[best] + self.bound[best] / steady
        with np.errstate(over="ignore"):
            score = 1.0 / (np.exp(-(entropy - entropy[best]) * min(n, STEADY)).sum() + np.exp(-(limit - entropy[best]) * min(n, STEADY)))
        return self.langs[best], float(score), bool(excess > self.bound[best]), float(excess), int(n)


class Scorer:
    """Scores texts with one model; keeps the sums of words seen before."""

    def __init__(self, model: Model):
        self.model, self.rows, self.sums = model, {}, np.empty((0, len(model.langs) + 1))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float, bool, float, int]]:
        split = [WORDS(t.lower()) if t else [] for t in texts]
        split = [w if any(c.isalpha() for word in w for c in word) else [] for w in split]  # signs like a superscript two are no letters
        new = list(set().union(*split).difference(self.rows)) if split else []
        if len(self.rows) + len(new) > KEPT:
            self.rows, self.sums = {}, self.sums[:0]
            new = list(set().union(*split))
        if new:
            added = np.concatenate([self.model.score_words(new[i : i + 20_000]) for i in range(0, len(new), 20_000)])
            self.rows.update(zip(new, range(len(self.sums), len(self.sums) + len(new)), strict=True))
            self.sums = np.concatenate([self.sums, added])
        nothing = np.zeros(len(self.model.langs) + 1)
        get = self.rows.__getitem__
        return [self.model.judge(self.sums[np.fromiter(map(get, w), np.int64, len(w))].sum(0) if w else nothing) for w in split]


def letters_of(counts: dict[str, dict[str, int]]) -> int:
    return max(len({g for raw in counts.values() for g in raw if len(g) == 1}), 1)


def smooth(counts: dict[str, dict[str, int]], letters: int | None = None) -> Model:
    """The Kneser-Ney models of several languages from raw n-gram counts by language; `letters` if there are more languages.

    The highest order, and n-grams that begin a word, keep their counts; the others count in how many different
    characters they are preceded by. Each order takes its discount from how many n-grams occur once and twice.
    """
    langs = sorted(counts)
    probability: list[dict[str, dict[str, float]]] = [{} for _ in range(ORDER)]
    weights: list[dict[str, dict[str, float]]] = [{} for _ in range(ORDER)]
    floors = []
    letters = letters or letters_of(counts)  # of all languages, so that each model shares one among them
    for lang in langs:
        raw = counts[lang]
        by_order: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
        before: Counter[str] = Counter(g[1:] for g in raw if len(g) > 1)
        for g, n in raw.items():
            by_order[len(g)][g] = n if len(g) == ORDER or g[0] == " " and len(g) > 1 else max(before.get(g, 0), 1)
        lower: dict[str, float] = {}
        floor = 1.0 / (letters + 1)
        for n in range(1, ORDER + 1):
            grams = by_order[n]
            freq = Counter(grams.values())
            discount = min(max(freq[1] / (freq[1] + 2 * freq[2]), 0.1), 0.9) if freq[1] else 0.5
            total: Counter[str] = Counter()
            kinds: Counter[str] = Counter()
            for g, c in grams.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            weight = {ctx: discount * kinds[ctx] / total[ctx] for ctx in total}
            now = {g: max(c - discount, 0.0) / total[g[:-1]] + weight[g[:-1]] * (lower.get(g[1:], floor) if n > 1 else floor) for g, c in grams.items()}
            for g, p in now.items():
                probability[n - 1].setdefault(g, {})[lang] = p
            if n == 1:
                floors.append(weight.get("", 1.0) * floor)
            else:
                for ctx, w in weight.items():
                    weights[n - 2].setdefault(ctx, {})[lang] = w
            lower = now
    floor = np.log(np.array(floors or [1.0]))[: len(langs)]
    hashes, logp, weight = [], [], []
    value: dict[str, np.ndarray] = {}
    for n in range(1, ORDER + 1):
        # as a context an n-gram may be known that is no n-gram to predict (a space that begins a word)
        grams = sorted(set(probability[n - 1]) | set(weights[n - 1]))
        codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
        hashed = _hashes(codes, n)[-1][n - 1 :: n] if grams else np.empty(0, np.uint64)
        p = np.empty((len(grams), len(langs)))
        w = np.zeros((len(grams), len(langs)))
        below = value
        value = {}
        for i, g in enumerate(grams):
            own = probability[n - 1].get(g, {})
            handed = weights[n - 2].get(g[:-1], {}) if n > 1 else {}
            short = below.get(g[1:], floor) if n > 1 else floor
            for k, lang in enumerate(langs):
                p[i, k] = math.log(own[lang]) if lang in own else short[k] + (math.log(handed[lang]) if lang in handed else 0.0)
                if lang in weights[n - 1].get(g, {}):
                    w[i, k] = math.log(weights[n - 1][g][lang])
            value[g] = p[i]
        order = np.argsort(hashed)
        hashes.append(hashed[order])
        logp.append(p[order])
        weight.append(w[order])
    return Model(langs, hashes, logp, weight, floor, np.zeros(len(langs)), np.full(len(langs), np.inf))


def _smoothed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From all rows (lang, gram, n): one row with the model and the number of letters."""
    counts: dict[str, dict[str, int]] = {}
    for batch in batches:
        for lang, own in batch.groupby("lang"):
            counts.setdefault(lang, {}).update(zip(own["gram"], own["n"].tolist(), strict=True))
    letters = letters_of(counts)
    model = pickle.dumps(smooth(counts))
    del counts
    give_back()
    yield pd.DataFrame({"model": [model], "letters": [letters]})


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows of (doc_id, text, lang). What comes to the driver is bounded by the sample: the model and a row a calibrating text."""
    drawn = cut(sample(labelled, per_language))
    grams = drawn.filter("not calibrate").select("lang", "text").mapInPandas(_ngrams, "lang string, gram string, n long")
    made = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).repartition(1).mapInPandas(_smoothed, "model binary, letters long").first()
    model, letters = (pickle.loads(made.model), made.letters) if made else (smooth({}), 1)
    kept_out = identify(drawn.filter("calibrate"), model, name="_found").select("lang", "_found.*").filter("n_letters > 0").collect()
    calibrate(model, [(r.lang, r.entropy, r.n_letters) for r in kept_out if r.lang == r.lang_pred], drawn, letters)
    tidy(labelled.sparkSession)
    return model


def _sums(model: Model, words: list[str]) -> np.ndarray:
    return sum(model.score_words(words[i : i + 20_000]).sum(0) for i in range(0, len(words), 20_000))


def _cross_validated(model: Model, lang: str, texts: list[str], letters: int) -> list[tuple[float, int]]:
    """Cross-entropy and characters of each different text under what the others say; those that another language fits better are left out."""
    split = [w for t in sorted(set(texts)) if (w := WORDS(t.lower())) and any(c.isalpha() for word in w for c in word)]
    own, folds, out = model.langs.index(lang), min(FOLDS, len(split)), []
    for fold in range(folds if folds > 1 else 0):
        rest = smooth({lang: _counted(Counter(word for k, w in enumerate(split) if k % folds != fold for word in w))}, letters)
        for w in split[fold::folds]:
            total, sums = _sums(rest, w), _sums(model, w)
            sums[own] = total[0]
            if int(np.argmax(sums[:-1])) == own:
                out.append((-float(total[0]) / total[1], int(total[1])))
    return out


def calibrate(model: Model, right: list[tuple[str, float, int]], drawn: DataFrame, letters: int) -> None:
    """Sets the usual cross-entropy and the bound of each language from (lang, entropy, characters) of rightly predicted rows."""
    rows: dict[str, list[tuple[float, int]]] = {lang: [] for lang in model.langs}
    for lang, e, n in right:
        rows[lang].append((e, min(n, STEADY)))
    few = [lang for lang in model.langs if len(rows[lang]) < CALIBRATED]
    if few:
        shared = drawn.sparkSession.sparkContext.broadcast(model)

        def tried(group: pd.DataFrame) -> pd.DataFrame:
            lang = group["lang"].iloc[0]
            tests = _cross_validated(shared.value, lang, list(group["text"]), letters)
            return pd.DataFrame({"k": shared.value.langs.index(lang), "entropy": [e for e, _ in tests], "n": [n for _, n in tests]}).astype({"k": "int64", "entropy": "float64", "n": "int64"})

        found: dict[str, list[tuple[float, int]]] = {}
        for r in drawn.filter(F.col("lang").isin(few)).select("lang", "text").groupBy("lang").applyInPandas(tried, "k long, entropy double, n long").collect():
            found.setdefault(model.langs[r.k], []).append((r.entropy, min(r.n, STEADY)))
        rows |= {lang: own for lang, own in found.items() if len(own) > len(rows[lang])}
    usual = lambda own: np.average([e for e, _ in own], weights=[n for _, n in own])
    excess = {lang: [(e - usual(own)) * math.sqrt(n) for e, n in own] for lang, own in rows.items() if own}
    bound = lambda found: max(3.0 * sorted(found)[min(len(found) - 1, int(0.995 * len(found)))], 0.5 * math.sqrt(STEADY))
    pooled = [row for own in rows.values() for row in own]
    for k, lang in enumerate(model.langs):
        own = rows[lang]
        model.usual[k] = usual(own or pooled) if pooled else math.log(letters + 1)
        if not pooled:
            model.bound[k] = 0.0
        else:
            model.bound[k] = bound(excess[lang] if len(own) >= CALIBRATED else [x for found in excess.values() for x in found])


def identify(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """`docs` with a struct `name` (in place of a column of that name, if there is one).

    Its fields: lang_pred, score, rejected, entropy (nats a character) and n_letters (scored characters).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = uuid.uuid4().hex

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = held(mark, lambda: Scorer(shared.value))
        usual = dict(zip(scorer.model.langs, scorer.model.usual, strict=True))
        for texts in batches:
            rows = []
            for i in range(0, len(texts), 500):
                rows += scorer.texts(list(texts.iloc[i : i + 500]))
            entropy = [x / math.sqrt(min(n, STEADY)) + usual[lang] if n else 0.0 for lang, _, _, x, n in rows]
            yield pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "rejected": [r[2] for r in rows], "entropy": entropy, "n_letters": [r[4] for r in rows]})
        give_back()

    judged_udf = F.pandas_udf(judged, "lang_pred string, score double, rejected boolean, entropy double, n_letters long", F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn(name, judged_udf(F.col(text)))
