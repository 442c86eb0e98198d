"""The Java patterns must find exactly what Python's ``re`` finds with the plain ones."""

import random
import re

from pyspark.sql import functions as F

from palimpsest.functions import patterns as P
from palimpsest.functions import text as X

# The plain patterns, the expected side of the comparison.
PY = {
    "special": r"""[^a-zA-Z0-9\s.,!?;:\'"()\-_/]{2,}""",
    "repeat": r"\b\w*([a-zA-Z])\1{2,}\w*\b",
    "general": r"\b(?!(?:\w{1,2}&\w{1,2}|\w+=\w+|\d+\*\d+)$)\S*[@#$%^&*+=<>\|\`~[\]{}]\S*\b",
    "caret": r"\^(\w{0,4})|(?<!\w)[^\w\s](?!\w)",
    "odd": r"\s{2,}|\S{15,}",
    "mixed": r"[a-z][A-Z]|[A-Z]{3,}[a-z]",
    "alpha": r"\b[a-zA-Z]+\b",
    "flagged": r"\[.*?\]",
    "word": r"\b\w+\b",
}
JAVA = {
    "special": P.SPECIAL,
    "repeat": P.REPEAT,
    "general": P.GENERAL,
    "caret": P.CARET,
    "odd": P.ODD_SPACING,
    "mixed": P.MIXED_CASE,
    "alpha": P.ALPHA_WORD,
    "flagged": P.FLAGGED_WORDS,
    "word": P.WORD_RUN,
}
ALPHABETS = [
    "aab=&*3^ \n",
    "aaabcXYZ    ½²é—٣😀𝐀&=*@.,!(){}[]^_-'\"/\r\n\t\x1c\x85",
    "abcABC   .!?()[]<>&^",
]


def py_sentences(text):
    ends = [m.end() for m in re.finditer(r"(?<=[.!?])\s+", text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]


def samples(n, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        letters = ALPHABETS[i % len(ALPHABETS)]
        rows.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 24))))
    return rows + ["AT&T", "x AT&T\n", "ab foo=bar", "12*34", "12*34\n", "a==b", "éé café 1022½"]


def test_patterns_agree_with_re(spark):
    texts = samples(12000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(4)
    cols = {f"f_{k}": F.regexp_extract_all("t", F.lit(p), F.lit(0)) for k, p in JAVA.items()}
    cols |= {f"r_{k}": F.regexp_replace("t", p, "") for k, p in JAVA.items()}
    cols["closed"] = X.strip_unclosed_paren(F.col("t"))
    cols["sentences"] = X.sentences(F.col("t"))
    cols["collapsed"] = F.regexp_replace("t", P.REPEAT, "$1")
    got = {r["id"]: r for r in df.select("id", *[c.alias(k) for k, c in cols.items()]).collect()}
    compiled = {k: re.compile(p) for k, p in PY.items()}
    for i, text in enumerate(texts):
        for k, p in compiled.items():
            assert got[i][f"f_{k}"] == [m.group(0) for m in p.finditer(text)], (k, text)
            assert got[i][f"r_{k}"] == p.sub("", text), (k, text)
        assert got[i]["closed"] == re.sub(r"\([^)]*$", "", text), text
        assert got[i]["sentences"] == py_sentences(text), text
        assert got[i]["collapsed"] == compiled["repeat"].sub(r"\1", text), text
