"""Joins and counts against direct enumeration on small random inputs."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from palimpsest.functions import scores as S
from palimpsest.operators import spelling


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def word(rng, n, letters="abé"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_suggestions_equal_all_pairs(spark):
    """Short words share deletions, long ones segments; lengths around the switch are dense."""
    rng = random.Random(11)
    lengths = [3, 4, 5, 6, *range(20, 32)]
    dictionary = {word(rng, rng.choice(lengths)): rng.randint(1, 5) for _ in range(150)}
    tokens = {word(rng, rng.choice(lengths)) for _ in range(60)}
    for w in list(dictionary):
        for edits in (1, 2, 3):
            t = list(w)
            for _ in range(edits):
                at, op = rng.randrange(len(t)), rng.choice("ids")
                t[at : at + (op != "i")] = [] if op == "d" else [rng.choice("abéz")]
            tokens.add("".join(t))
    tokens = {t for t in tokens if t and t not in dictionary}
    got = spelling.suggest(
        spark.createDataFrame([(t,) for t in tokens], "token string"),
        spark.createDataFrame(list(dictionary.items()), "word string, freq long"),
    )
    want = {}
    for t in tokens:
        near = [(levenshtein(t, w), -f, w) for w, f in dictionary.items() if abs(len(w) - len(t)) <= 2]
        near = [n for n in near if n[0] <= 2]
        if near:
            want[t] = min(near)[2]
    assert {r.token: r.correction for r in got.collect()} == want
    assert any(len(t) > 26 for t in want) and any(len(t) < 8 for t in want)


def test_deletion_keys_are_rows_of_two_places(spark):
    """One row per deletion, made from places; no array holds the shortened texts of a word."""
    tokens = ["", "é", "ab", "tablé", "x" * 22, "abcdefghijklmnopqrstuvwxyz", "a" * 27, None]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    keyed = spelling._keyed(df, "token", 26, F.array(F.lit("part"), F.lit("other")), 26)
    got = Counter((r.token, r.shared) for r in keyed.collect())
    left = [
        (t, "".join(c for k, c in enumerate(t) if k not in (i, j)))
        for t in tokens
        if t is not None and len(t) <= 26
        for i in range(len(t) + 1)
        for j in range(i + 1, max(len(t), i + 1) + 1)
    ]
    assert len(left) == sum(1 + len(t) * (len(t) + 1) // 2 for t in tokens if t is not None and len(t) <= 26)
    left += [("a" * 27, "part"), ("a" * 27, "other")]
    hashed = spark.createDataFrame(left, "t string, k string").select("t", F.xxhash64("k").alias("h"))
    assert got == Counter((r.t, r.h) for r in hashed.collect())
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(made) == 2 and not any("lambda" in line for line in made)


def test_correct_spelling_keeps_case_and_surroundings(spark):
    dictionary = spark.createDataFrame(
        [("the", 9), ("board", 3), ("directors", 2), ("don't", 2), ("then", 1)], "word string, freq long"
    )
    texts = [
        (1, "TKE Board, oi (Directirs) don't! 1949 tke\n\nBorad zzzzzzz"),
        (2, None),
        (3, "  "),
        (4, "ab 123 Tha"),
    ]
    df = spark.createDataFrame(texts, "id int, t string")
    got = {r.id: r.corrected_transcript for r in spelling.correct_spelling(df, "id", "t", dictionary).collect()}
    assert got == {
        1: "THE Board, oi (Directors) don't! 1949 the\n\nBoard zzzzzzz",
        2: None,
        3: "  ",
        4: "ab 123 The",
    }


def test_vocabulary(spark):
    df = spark.createDataFrame([("The cat", "a CAT"), (None, "don't")], "a string, b string")
    got = {r.word: r.freq for r in spelling.build_vocabulary(df, ["a", "b"]).collect()}
    assert got == {"the": 1, "cat": 2, "a": 1, "don't": 1}


def py_bleu(r, h, n=4):
    if not set(r) & set(h):
        return 0.0
    orders, total = min(n, len(h)), 0.0
    for k in range(1, orders + 1):
        gr, gh = (Counter(tuple(t[i : i + k]) for i in range(len(t) - k + 1)) for t in (r, h))
        m, p = sum((gr & gh).values()), len(h) - k + 1
        total += math.log(m / p if k == 1 else (m + 1) / (p + 1))
    return math.exp(min(0, 1 - len(r) / len(h)) + total / orders)


def py_jsd(a, b):
    if not a or not b:
        return float(bool(a) != bool(b))
    ca, cb, out = Counter(a), Counter(b), 0.0
    for v in ca.keys() | cb.keys():
        p, q = ca[v] / len(a), cb[v] / len(b)
        out += sum(0.5 * x * math.log2(x / ((p + q) / 2)) for x in (p, q) if x)
    return out


def test_scores(spark):
    rng = random.Random(3)
    pairs = [
        tuple(" ".join(rng.choice(v.split()) for _ in range(rng.randint(0, 14))) for v in ("a b c d éf", "a b c d gg"))
        for _ in range(300)
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    toks = df.select("*", S.score_tokens(F.col("a")).alias("x"), S.score_tokens(F.col("b")).alias("y"))
    x, y = F.col("x"), F.col("y")
    out = toks.select(
        "i", S.bleu(x, y).alias("bleu"), S.js_divergence(x, y).alias("jsd"), S.rouge_l(x, y).alias("rouge"),
        S.jaccard(x, y).alias("jaccard"), S.levenshtein_sim(F.col("a"), F.col("b")).alias("lev"),
    )
    for r in out.collect():
        a, b = pairs[r.i]
        s, t = a.split(), b.split()
        want = {
            "bleu": py_bleu(s, t),
            "jsd": py_jsd(s, t),
            "rouge": 2 * lcs(s, t) / (len(s) + len(t)) if s or t else 0.0,
            "jaccard": len(set(s) & set(t)) / len(set(s) | set(t)) if s or t else 1.0,
            "lev": 1 - levenshtein(a, b) / max(len(a), len(b)) if a or b else 1.0,
        }
        for k, v in want.items():
            assert abs(r[k] - v) < 1e-9, (k, a, b)


def test_bit_rows_on_long_texts():
    rng = random.Random(9)
    for _ in range(200):
        a, b = (word(rng, rng.randint(0, 150), "abcd") for _ in range(2))
        assert S.edit_distance(a, b) == levenshtein(a, b)
        assert S.lcs_length(a, b) == lcs(a, b)
