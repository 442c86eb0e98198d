"""Toxicity scores by a subsequence string kernel and a support vector machine.

The kernel of two words counts their common subsequences of ``ORDER`` characters, gaps allowed:
a subsequence that spans s characters weighs ``DECAY ** s``, spans over ``SPAN`` count for nothing.
So ``m.o.r.o.n`` or ``moxron`` stay close to the word they hide.  Kernels are normalised by both
words' own.  Landmarks are words of the training sentences; the Nyström map of a word is its kernel
with the landmarks, whitened by the landmarks' own kernel matrix, and a linear support vector
machine (squared hinge) is trained in that space.

A sentence is as toxic as its worst word and a text as its worst sentence.  Labels are given for
texts, so training alternates: the worst words of each toxic text are positive, all words of clean
texts negative, of which the ones that score highest are added in turn.  A logistic curve over the
texts' scores gives numbers from 0 to 1.

Map and machine are linear in a word's subsequence weights, hence one table of weights by
subsequence scores any word.  The fit uses at most ``TOXIC_SAMPLE`` and ``CLEAN_SAMPLE`` labelled
texts, those with the smallest hash of their id; every text is scored whole, in Arrow batches,
without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 3
SPAN = 7
DECAY = 0.6
LANDMARKS = 160
TOXIC_SAMPLE = 1200
CLEAN_SAMPLE = 1800
ROUNDS = 4
#: Disguised copies of each positive word that the machine also learns from.
DISGUISES = 8
#: Weight of all positive words together against all negative ones: a text has many chances to be wrong.
POSITIVE = 0.25
#: A word of toxic texts alone is positive for certain where chance would give it so with this probability.
CHANCE = 1e-5
#: Words whose scores a worker remembers while it reads one partition.
REMEMBERED = 400_000
#: Characters: letters of English, and all other letters as one class; 0 stands for marks and digits.
_CODES = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
_OTHER, _SIZE = 27, 28
_SPACED = re.compile(r"(?<!\S)(?:\w ){3,}\w(?!\w)")
#: Longer words are scored in overlapping parts of this length, whole.
_PART = 24
#: Bounds on the fit, which has a bounded sample anyway: words of each side that landmarks are chosen from, and
#: negative words of clean texts, the commonest and the highest scored at first and those added in each round.
LANDMARK_WORDS = 4000
FIRST_NEGATIVES = 3000
MORE_NEGATIVES = 1500
#: Words whose features are worked out at once.
_CHUNK = 4000
_GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]


def text_words(text: str | None) -> set[str]:
    """Distinct words of a text in small letters, edge marks cut; single letters in a row make one word."""
    text = (text or "").lower()
    found = {w.strip(".,;:!?\"'()[]{}") for w in text.split()}
    for run in _SPACED.findall(text):
        found.add(run.replace(" ", ""))
    found.discard("")
    return found


def _parts(word: str) -> list[str]:
    if len(word) <= _PART:
        return [word]
    step = _PART - SPAN + 1
    return [word[i : i + _PART] for i in range(0, len(word) - SPAN + 1, step)]


def _folded(char: str) -> int:
    """Code of a character; accents are taken off, what is no letter only widens gaps."""
    code = _CODES.get(char)
    if code is None:
        code = _CODES.get(unicodedata.normalize("NFD", char)[0], _OTHER if char.isalpha() else 0)
        if len(_CODES) < 10_000:
            _CODES[char] = code
    return code


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, subsequence, weight) of words of at most ``_PART`` characters, each row of length 1."""
    width = max([1, *map(len, words)])
    codes = np.zeros((len(words), width + SPAN), np.int64)
    for i, w in enumerate(words):
        codes[i, : len(w)] = [_folded(c) for c in w]
    rows, keys, weights = [], [], []
    for a, b in _GAPS:
        first, second, third = codes[:, :width], codes[:, a : a + width], codes[:, b : b + width]
        at, _ = hit = np.nonzero(third)
        rows.append(at)
        keys.append((first[hit] * _SIZE + second[hit]) * _SIZE + third[hit])
        weights.append(np.full(len(at), DECAY ** (b + 1)))
    row, key, weight = np.concatenate(rows), np.concatenate(keys), np.concatenate(weights)
    held = (key % _SIZE > 0) & (key // _SIZE % _SIZE > 0) & (key // _SIZE**2 > 0)  # marks are gaps
    row, key, weight = row[held], key[held], weight[held]
    both = row * _SIZE**3 + key
    order = np.argsort(both)
    both, weight = both[order], weight[order]
    starts = np.flatnonzero(np.diff(both, prepend=-1))
    weight = np.add.reduceat(weight, starts) if len(starts) else weight
    row, key = both[starts] // _SIZE**3, both[starts] % _SIZE**3
    norm = np.sqrt(np.bincount(row, weight**2, len(words)))
    return row, key, weight / norm[row]


@dataclass
class Model:
    """Weights by subsequence, and the logistic curve of a text's score."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Machine output of every word: of a long one, that of its worst part."""
        parts = [(i, p) for i, w in enumerate(words) for p in _parts(w)]
        if not parts:
            return np.zeros(0)
        row, key, weight = features([p for _, p in parts])
        made = np.bincount(row, weight * self.weights[key], len(parts)) + self.bias
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, [i for i, _ in parts], made)
        return out

    def chance(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 3e-4, rounds: int = 30) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; the last number is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty * weight.sum())
    ridge[-1] *= 1e-3
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve((xa * wa[:, None]).T @ xa + np.diag(ridge), (xa * wa[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _landmarks(toxic: list[str], clean: list[str], count: int) -> list[str]:
    """Half from each side, chosen one by one far from those before."""
    chosen: list[str] = []
    for words in (toxic, clean):
        words = [p for w in words for p in _parts(w) if len(p) >= ORDER][:LANDMARK_WORDS]
        if not words:
            continue
        row, key, weight = features(words)
        bounds = np.searchsorted(row, np.arange(len(words) + 1))
        near = np.zeros(len(words))
        at = 0
        for _ in range(min(count // 2, len(words))):
            chosen.append(words[at])
            line = np.zeros(_SIZE**3)
            line[key[bounds[at] : bounds[at + 1]]] = weight[bounds[at] : bounds[at + 1]]
            near = np.maximum(near, np.bincount(row, weight * line[key], len(words)))
            at = int(near.argmin())
            if near[at] > 0.999:
                break
    return chosen


class _Vocabulary:
    """Words with their features, computed once."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        parts = [(i, p) for i, w in enumerate(words) for p in _parts(w)]
        self.owner = np.array([i for i, _ in parts], np.int32)
        self.count = len(parts)
        made = [features([p for _, p in parts[lo : lo + _CHUNK]]) for lo in range(0, len(parts), _CHUNK)]
        self.row = np.concatenate([r.astype(np.int32) + _CHUNK * k for k, (r, _, _) in enumerate(made)])
        self.key = np.concatenate([k.astype(np.int32) for _, k, _ in made])
        self.weight = np.concatenate([w.astype(np.float32) for _, _, w in made])

    def scores(self, model: Model) -> dict[str, float]:
        made = np.bincount(self.row, self.weight * model.weights[self.key], self.count) + model.bias
        out = np.full(len(self.words), -np.inf)
        np.maximum.at(out, self.owner, made)
        return dict(zip(self.words, out.tolist(), strict=True))

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        """Share of the texts that hold each subsequence."""
        place = {w: i for i, w in enumerate(self.words)}
        first = np.searchsorted(self.row, np.searchsorted(self.owner, np.arange(len(self.words) + 1)))
        held = np.zeros(_SIZE**3)
        for ws in texts:
            held[np.unique(np.concatenate([self.key[first[i] : first[i + 1]] for i in map(place.get, ws)]))] += 1
        return held / len(texts)


def _odds(toxic, clean, n_toxic: int, n_clean: int, prior: float = 10.0):
    """Log ratio of two rates, each drawn to the common one by ``prior`` texts."""
    rate = (toxic + clean + 1e-3) / (n_toxic + n_clean)
    return np.log((toxic + prior * rate) / (n_toxic + prior)) - np.log((clean + prior * rate) / (n_clean + prior))


def _disguised(word: str, count: int, draw: np.random.Generator) -> list[str]:
    """Copies of a word with one letter put in or doubled, or marks between all letters."""
    out = [".".join(word)] if count else []
    for k in range(count - 1):
        at = int(draw.integers(1, max(2, len(word))))
        out.append(word[:at] + (word[at - 1] if k % 2 else chr(97 + int(draw.integers(26)))) + word[at:])
    return out


def _trained(positive: list[str], negative: list[str], marks: list[str], in_toxic: Counter) -> Model:
    """The machine over the Nyström features of both sides."""
    mrow, mkey, mweight = features(marks)
    table = np.zeros((len(marks), _SIZE**3))
    table[mrow, mkey] = mweight
    values, vectors = np.linalg.eigh(table @ table.T)
    values, vectors = values[values > 1e-6], vectors[:, values > 1e-6]
    project = vectors / np.sqrt(values)
    draw = np.random.default_rng(0)
    pos: list[tuple[str, float]] = []
    for w in positive:
        # A word counts for the texts it stands in; a disguise counts a quarter.
        mass = 1.0 + np.log1p(in_toxic.get(w, 1))
        pos += [(p, mass) for p in _parts(w)]
        if in_toxic.get(w, 0) > 1 and len(w) >= 4:
            pos += [(p, mass / 4) for d in _disguised(w, DISGUISES, draw) for p in _parts(d)]
    neg = [p for w in negative for p in _parts(w)]
    row, key, weight = features([p for p, _ in pos] + neg)
    kernel = np.empty((len(pos) + len(neg), len(marks)))
    for j in range(len(marks)):
        kernel[:, j] = np.bincount(row, weight * table[j, key], len(kernel))
    y = np.array([1.0] * len(pos) + [-1.0] * len(neg))
    mass = np.array([m for _, m in pos] + [1.0] * len(neg))
    mass[: len(pos)] *= POSITIVE * len(neg) / mass[: len(pos)].sum()
    w = _machine(kernel @ project, y, mass)
    return Model(table.T @ (project @ w[:-1]), float(w[-1]))


def _distinct(texts: list[set[str]], bands: int = 6) -> list[set[str]]:
    """The texts without near-copies of earlier ones, whose words would look like evidence."""
    seen: dict[tuple[int, ...], list[int]] = {}
    kept: list[set[str]] = []
    for ws in texts:
        raw = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in ws], np.uint64)
        low = [int((raw * np.uint64(2 * k + 1) * np.uint64(2654435761) % np.uint64(4294967291)).min()) for k in range(2 * bands)]
        keys = [(b, low[2 * b], low[2 * b + 1]) for b in range(bands)]
        near = {i for key in keys for i in seen.get(key, ())}
        if any(2 * len(ws & kept[i]) > len(ws | kept[i]) for i in near):
            continue
        for key in keys:
            seen.setdefault(key, []).append(len(kept))
        kept.append(ws)
    return kept


def fit(texts: list[tuple[set[str], int]], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model | float:
    """A model of ``(words, toxic)``; the share of toxic texts where one of the two kinds is missing."""
    toxic = [sorted(w) for w in _distinct([w for w, t in texts if t and w])]
    clean = [sorted(w) for w in _distinct([w for w, t in texts if not t and w])]
    if not toxic or not clean:
        return sum(t for _, t in texts) / len(texts) if texts else 0.0
    in_clean = Counter(w for ws in clean for w in ws)
    in_toxic = Counter(w for ws in toxic for w in ws)
    vocabulary = _Vocabulary(sorted(in_clean | in_toxic))

    # Start: how much more often a word and its subsequences stand in toxic texts.
    held = vocabulary.shares(toxic) * len(toxic), vocabulary.shares(clean) * len(clean)
    odds = _odds(*held, len(toxic), len(clean))
    score = vocabulary.scores(Model(odds, 0.0))
    lift = {w: float(_odds(in_toxic[w], in_clean[w], len(toxic), len(clean))) for w in in_toxic}
    positive = {max(ws, key=lambda w: (score[w] + 2 * lift[w], w)) for ws in toxic}
    # Words seen in so many toxic texts, and in no clean one, that chance does not explain it.
    enough = np.log(CHANCE) / np.log(len(toxic) / (len(toxic) + len(clean)))
    sure = {w for w, n in in_toxic.items() if n >= enough and not in_clean[w]}
    positive |= sure
    negative = {w for w, _ in in_clean.most_common(FIRST_NEGATIVES)}
    negative |= set(sorted(in_clean, key=lambda w: (-score[w], w))[:FIRST_NEGATIVES])
    model = Model(odds, 0.0)
    for _ in range(rounds):
        negative -= positive
        order = sorted(positive, key=lambda w: (-in_toxic[w], w))
        marks = _landmarks(order, sorted(negative, key=lambda w: (-score[w], w)), landmarks)
        model = _trained(order, sorted(negative), marks, in_toxic)
        score = vocabulary.scores(model)
        # Of each toxic text its worst word, and any other that the machine is sure of.
        positive = {max(ws, key=lambda w: (score[w] + lift[w], w)) for ws in toxic}
        positive |= sure | {w for w in in_toxic if score[w] > 0.5 and not in_clean[w]}
        positive = {w for w in positive if 20 * in_clean[w] * len(toxic) <= in_toxic[w] * len(clean)}
        negative |= set(sorted(in_clean, key=lambda w: (-score[w], w))[:MORE_NEGATIVES])
        if not positive:
            break
    best = np.array([max(score[w] for w in ws) for ws in toxic + clean])
    label = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    model.slope, model.shift = _curve(best, label)
    return model


def _curve(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number, with a little pull to the middle."""
    w = np.array([1.0, 0.0])
    x = np.stack([score, np.ones(len(score))], 1)
    goal = label * 0.998 + 0.001
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - goal) + 1e-2 * np.array([w[0], 0.0]))
    return float(w[0]), float(w[1])


def learned(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE) -> Model | float:
    """Fit on bounded samples of both labels; texts whose id's remainder is 0 are held out.

    Null labels are left out; a text labelled both ways counts as toxic.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out())
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = known.where("toxic = 1").orderBy(*order).limit(toxic).union(known.where("toxic <> 1").orderBy(*order).limit(clean))
    # A few thousand rows of two numbers at any size of the input.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    @F.pandas_udf("array<string>")
    def distinct(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(text_words(t)))

    found = rows.select("doc_id", distinct("text").alias("words"), "toxic").orderBy("doc_id", F.hash("words"))
    return fit([(set(r["words"]), int(r["toxic"] == 1)) for r in found.toLocalIterator()])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Texts without a word, null ones included, get the smallest chance that the model gives.
    Repeated rows are scored alike; a null id is not held out.  Other columns are ignored.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in parts:
            out = np.zeros(len(texts))
            for lo in range(0, len(texts), 256):
                words = [text_words(t) for t in texts.iloc[lo : lo + 256]]
                new = sorted(set().union(*words) - known.keys())
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = sorted(set().union(*words))
                for at in range(0, len(new), 4096):
                    some = new[at : at + 4096]
                    known.update(zip(some, model.word_scores(some).tolist(), strict=True))
                out[lo : lo + 256] = [max(map(known.__getitem__, ws), default=-1e3) for ws in words]
            yield pd.Series(model.chance(out))

    value = F.lit(float(model)) if isinstance(model, float) else score("text")
    rows = docs.select("doc_id", held_out().alias("held_out"), value.alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
