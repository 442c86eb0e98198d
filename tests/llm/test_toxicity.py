"""Toxicity: kernel values by brute force, held-out accuracy, disguises and edge rows."""

import itertools

import numpy as np
import pytest

from palimpsest.llm import toxicity as X


def plain_kernel(a, b):
    def weights(w):
        out = {}
        for at in itertools.combinations(range(len(w)), X.ORDER):
            letters = "".join(w[i] for i in at)
            if letters.isalpha() and at[-1] - at[0] < X.SPAN:
                out[letters] = out.get(letters, 0) + X.DECAY ** (at[-1] - at[0] + 1)
        return out

    u, v = weights(a), weights(b)
    norm = np.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))
    return sum(x * v.get(k, 0) for k, x in u.items()) / norm


def test_kernel():
    words = ["moron", "mo.ron", "banana", "xmorxon", "nanabanan"]
    row, key, weight = X.features(words)
    dense = np.zeros((len(words), X._SIZE**3))
    dense[row, key] = weight
    for i, j in itertools.product(range(len(words)), repeat=2):
        assert dense[i] @ dense[j] == pytest.approx(plain_kernel(words[i], words[j]))


@pytest.fixture(scope="module")
def texts():
    draw = np.random.default_rng(3)
    parts = ["an", "the", "ing", "ou", "ha", "re", "st", "ble", "er", "nd", "th", "es"]
    plain = ["".join(draw.choice(parts, draw.integers(1, 5))) for _ in range(4000)]
    bad = ["villain", "rotter", "scoundrel", "knucklehead"]

    def text(toxic):
        ws = list(draw.choice(plain, draw.integers(5, 60)))
        if toxic:
            ws[draw.integers(len(ws))] = str(draw.choice(bad))
        return set(ws), int(toxic)

    return [text(i % 5 == 0) for i in range(1500)]


def test_held_out_accuracy_and_disguises(texts):
    model = X.fit(texts[:1000])

    def chance(words):
        return float(model.chance(np.array([model.word_scores(sorted(words)).max()]))[0])

    right = sum((chance(w) >= 0.5) == bool(t) for w, t in texts[1000:])
    assert right >= 0.97 * 500
    assert all(chance({w}) >= 0.5 for w in ("villain", "v.i.l.l.a.i.n", "scoun-drel", "knuckle-head", "rottter"))
    assert chance({"thing"}) < 0.5


def test_words():
    assert X.text_words('He is so m o r o n, "Trash"!') >= {"moron", "trash", "he"}
    assert X.text_words(None) == X.text_words(" \n") == set()


def test_query_shape_and_odd_rows(docs, odd, none, labels):
    model = X.learned(docs, labels)
    rows = X.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert X.scored(none, model).count() == 0
    assert X.scored(odd, X.learned(docs, labels.limit(0))).count() == odd.count()
    assert X.learned(none, labels) == 0.0


def test_held_out_labels_are_not_learned(docs, labels, spark):
    flipped = labels.withColumn("toxic", labels.toxic)
    held = {r.doc_id for r in docs.select("doc_id").where(X.held_out()).collect()}
    rows = [(r.doc_id, r.quality, 1 - r.toxic if r.doc_id in held else r.toxic) for r in flipped.collect()]
    other = spark.createDataFrame(rows, labels.schema)
    first, second = X.learned(docs, labels), X.learned(docs, other)
    assert isinstance(first, X.Model) and np.allclose(first.weights, second.weights)
