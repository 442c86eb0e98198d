"""Licence scan: every notice is found and confirmed at any width, background is not, figures agree with plain Python."""

import math
import re
import textwrap
from dataclasses import replace

import pytest
import regex
import xxhash
from palimpsest.llm import license_scan as L
from palimpsest.llm.license_texts import NAMES, TEMPLATES, UNKNOWN


@pytest.fixture(scope="module")
def scanner(spark, sf_dir):
    return L.trained(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def plain_paragraphs(text):
    """Lines without comment marks, those that end in the middle of a sentence joined to the next."""
    out = []
    for line in (text or "").split("\n") if text is not None else []:
        line = re.sub(r"^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--)(?=[ \t\r]|$)", "", line)
        line = re.sub(r"[ \t]*(?:\*+/|-->)[ \t\r]*$", "", line)
        if out and line.strip() and regex.search(r"[\p{L}\p{N},;:()/-][ \t\r]{0,4}$", out[-1]):
            out[-1] += " " + line.lstrip(" \t")
        else:
            out.append(line)
    return out


def plain_tokens(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]


def plain_probabilities(tokens, scanner):
    a = [(xxhash.xxh64_intdigest(w.encode(), 42) & (L.WORD_HASHES - 1)) + 1 for w in tokens]
    follow = 2 * L.WORD_HASHES
    twos = [x * follow + y for x, y in zip(a, a[1:])]
    slots = {g % L.SLOTS for g in (*a, *twos, *(x * follow + y for x, y in zip(twos, a[2:])))}
    sums = list(scanner.intercepts)
    for i in slots:
        sums = [x + y for x, y in zip(sums, scanner.weights.get(i, [0.0] * len(sums)))]
    e = [math.exp(x - max(sums)) for x in sums]
    return [x / sum(e) for x in e]


def plain_similarity(tokens, family):
    def pairs(words):
        return set(zip(words, words[1:]))

    own = pairs(tokens)
    shares = [0.0]
    for text in (*TEMPLATES[family], *NAMES[family]):
        given = pairs(plain_tokens(text))
        shares += [len(own & given) / max(len(given), 1), len(own & given) / max(len(own), 4)]
    return max(shares)


def test_figures_agree_with_plain_python(scanner, frame, docs):
    texts = [t for ts in TEMPLATES.values() for t in ts] + list(UNKNOWN) + ["MIT", "a b", "", None, "no\nrights, here\n\n# MIT License\r\n"]
    df = frame(list(enumerate(texts))).unionByName(docs.limit(40).withColumn("doc_id", docs.doc_id + 1000))
    got = {(r.doc_id, r.paragraph): r for r in L.scan(df, replace(scanner, threshold=0.0)).collect()}
    seen = 0
    for r in df.collect():
        for k, part in enumerate(plain_paragraphs(r.text)):
            tokens = plain_tokens(part)
            if not tokens:
                assert (r.doc_id, k) not in got
                continue
            row, seen = got[r.doc_id, k], seen + 1
            chances = plain_probabilities(tokens, scanner)
            assert abs(row.probability - max(chances[1:])) < 1e-9 and abs(chances[L.FAMILIES.index(row.family)] - row.probability) < 1e-9
            assert abs(row.similarity - plain_similarity(tokens, row.family)) < 1e-9 and row.confirmed == (row.similarity >= L.CONFIRM)
    assert seen == len(got) and seen > 100


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_wrapped_notices_are_confirmed(scanner, frame, mark):
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            for width in (30, 50, 72, 500):
                body = "\n".join(mark + x for x in textwrap.wrap(text, width))
                rows.append((len(rows), f"Some words before.\n\n{body}\n\nlast line", family, "s"))
    found = {}
    for r in L.scan(frame(rows), scanner).collect():
        found.setdefault(r.doc_id, set()).add((r.family, r.confirmed, r.paragraph))
    assert not [r for r in rows if (r[2], True, 2) not in found.get(r[0], ())]


def test_identifiers_and_bare_names(scanner, frame):
    lines = {
        "SPDX-License-Identifier: MIT": "mit", "MIT License": "mit", "Apache-2.0": "apache", "licensed GPLv3 or later": "gpl",
        "// SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl", "BSD-3-Clause": "bsd", "License: CC-BY-NC-4.0": "cc-by-nc",
        "This project is licensed under the well known MIT License.": "mit", "Licensed under Apache License Version 2.0": "apache",
    }
    rows = list(enumerate(lines))
    assert {r.doc_id: r.family for r in L.scan(frame(rows), scanner).collect()} == {i: lines[t] for i, t in rows}


def test_unknown(scanner, frame, docs):
    assert not L.scan(frame(list(enumerate(UNKNOWN))), scanner).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = L.scan(docs, scanner).collect()
    assert all("licen" in plain_paragraphs(texts[r.doc_id])[r.paragraph].lower() for r in found if r.confirmed)
    named = {i for i, t in texts.items() if "icensed under" in t or "MIT License" in t}
    assert named and named == {r.doc_id for r in found if r.confirmed}


def test_every_paragraph_is_scored(scanner, frame):
    rows = [(1, "SPDX-License-Identifier: MIT.\n\nMIT License.\nApache-2.0"), (2, "no rights are named here")]
    got = L.scan(frame(rows), replace(scanner, threshold=0.0)).collect()
    assert {(r.doc_id, r.paragraph) for r in got} == {(1, 0), (1, 2), (1, 3), (2, 0)}
    assert not [r for r in got if r.doc_id == 2 and r.confirmed]


def test_every_background_passage_is_learned_from(spark, frame):
    rows = [(i, f"passage number n{i} of many\n\nits second line l{i}") for i in range(900)]
    made = L._examples(spark, frame(rows)).select("tokens", "fold").collect()
    folds = {w: r.fold for r in made for w in r.tokens}
    assert all(f"n{i}" in folds and f"l{i}" in folds for i in range(900))
    assert 700 < sum(folds[f"{c}{i}"] for i in range(900) for c in "nl") < 1100


def test_odd_rows(scanner, odd, none):
    assert L.scan(odd, scanner).count() == 0 and L.scan(none, scanner).count() == 0
    assert L.trained(odd.sparkSession, none.select("text")).threshold == L.LEAST
    plan = L.scan(odd, scanner)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "")
