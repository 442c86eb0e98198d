"""Scalar functions on the edge rows; expected values are worked out by hand or by ``re``."""

import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import draws, parsing
from palimpsest.functions import patterns as P
from palimpsest.functions import text as X
from palimpsest.functions.rounding import round_ratio

NBSP = "\u00a0"


def apply(spark, values, *cols):
    """Evaluate columns over ``v`` for each value; one tuple (or scalar) per value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    named = [c.alias(f"c{k}") for k, c in enumerate(cols)]
    rows = sorted(df.select("i", *named).collect(), key=lambda r: r["i"])
    return [r[1] if len(cols) == 1 else tuple(r)[1:] for r in rows]


V = None


@pytest.fixture(autouse=True, scope="module")
def column_v(spark):
    global V
    V = F.col("v")


def test_repeat_letters_and_collapse(spark):
    got = apply(spark, ["Helllo wooorld AT&T x", None], X.repeat_letters(V), X.collapse_repeats(V),
                X.collapse_repeats(V, "squeeze"))
    assert got[0] == (["l", "o"], "l o AT&T x", "Helo world AT&T x")
    assert got[1] == ([], None, None)


def test_general_before_and_after_exceptions(spark):
    texts = ["a[b c{d 3*4 a@b.c foo=bar", "A&B", "AT&T x", "x AT&T", "12*34 and 5*6"]
    before = X.find_sequences(V, P.GENERAL)
    got = apply(spark, texts, before, X.general_sequences(V), X.remove_general(V))
    assert got[0][0] == ["a[b", "c{d", "3*4", "a@b.c", "=bar"]
    assert got[1][:2] == (["&B"], ["&B"])
    assert got[2] == (["AT&T"], [], " x")
    assert got[3][:2] == (["&T"], ["&T"])
    assert got[4][:2] == (["12*34", "*6"], ["*6"])


def test_special_and_caret_see_unicode(spark):
    text = f"x{NBSP}{NBSP}y éé café 1022½"
    got = apply(spark, [text], X.special_sequences(V), X.strip_stray_punct(V))
    assert got == [(["éé"], text)]


def test_caret_then_paren(spark):
    step = X.strip_stray_punct(V)
    got = apply(spark, ["^fele he - said (open"], step, X.strip_unclosed_paren(step))
    assert got == [(" he  said (open", " he  said ")]


def test_space_runs(spark):
    got = apply(spark, ["a  b", "a   b", "a    b", "a\t\tb"], X.normalize_spaces(V))
    assert got == ["a b", "a b", "a\nb", "a\t\tb"]


def test_extract_year(spark):
    got = apply(spark, ["June 4, 1948", "1947-06-09", None], X.extract_year(V), X.extract_year(V, "first4run"),
                X.year_or_zero(X.extract_year(V)))
    assert got == [("4194", "1948", 4194), ("1947", "1947", 1947), ("", "", 0)]


def test_lengths_and_blanks(spark):
    texts = [None, "", " \t\x1c\u0020x \n", "a b\tc"]
    got = apply(spark, texts, X.normalize_blank(V), X.char_len_nospace(V), X.is_blank(V))
    assert got == [("", None, True), ("", 0, True), ("x", 4, False), ("a b\tc", 4, False)]


def test_length_bucket(spark):
    lengths = [0, 1, 5, 6, 20, 21]
    got = apply(spark, ["x" * n for n in lengths] + ["  " + "x" * 5 + "\n", None], X.length_bucket(V))
    assert got == ["empty", "1-5", "1-5", "6-20", "6-20", "over_20", "1-5", "empty"]


def test_tokens_follow_python_split(spark):
    texts = ["", "  ", f"a{NBSP}b\x1cc ", " x  y\n"]
    assert apply(spark, texts, X.tokens(V)) == [t.split() for t in texts]


def test_keep_where_and_first_nonempty(spark):
    kept = X.keep_where(V, F.length(V) > 1)
    got = apply(spark, ["ab", "c", ""], kept, X.first_nonempty(kept, F.upper(V)))
    assert got == [("ab", "ab"), ("", "C"), ("", "")]


def test_substitutions_apply_documented_rules(spark):
    got = apply(spark, ["a___b — c**d_e*f"], X.substitute_patterns(V))
    assert got == ["a b - c d_e*f"]


def test_removal_orders_differ(spark):
    text = "aaa@b x éé©© Helllo"
    a, b = apply(spark, [text], X.remove_patterns(V, "A"), X.remove_patterns(V, "B"))[0]
    assert (a, b) == (" x  l", " x  l")
    text = "$$oooo#x ok"
    a, b = apply(spark, [text], X.remove_patterns(V, "A"), X.remove_patterns(V, "B"))[0]
    assert (a, b) == (" ok", " ok")


def test_messy_score(spark):
    texts = [None, "", "abc", "^" + "a" * 79, "aB  cD", "<" * 3 + "x" * 397]
    got = apply(spark, texts, X.messy_score(V), X.is_messy(X.messy_score(V)))
    assert got[0] == (None, False)
    assert got[1] == (0.0, False)
    assert got[2] == (0.0, False)
    # one mark and one 15-character token over 80 characters
    assert got[3][0] == round(2 / 80, 3)
    assert got[4] == (round(3 / 6, 3), True)
    assert got[5][0] == round(4 / 400, 3)


def test_round_ratio_is_python_round(spark):
    rng = random.Random(5)
    pairs = [(k, n) for n in (8, 16, 40, 80, 400, 800, 2000) for k in range(n)]
    pairs += [(rng.randrange(n + 1), n) for n in (rng.randrange(1, 10**7) for _ in range(2000))]
    df = spark.createDataFrame(pairs, "k long, n long")
    cols = [round_ratio(F.col("k"), F.col("n"), 3), round_ratio(F.col("k"), F.col("n"), 1, 100)]
    for k, n, a, b in df.select("k", "n", *cols).collect():
        assert a == round(k / n, 3), (k, n)
        assert b == round(k / n * 100, 1), (k, n)
    zero = spark.range(1).select(round_ratio(F.lit(0), F.lit(0), 3)).first()[0]
    assert zero is None


def test_sentence_split_keeps_formatting(spark):
    def py(text, ratio):
        import re

        ends = [m.end() for m in re.finditer(r"(?<=[.!?])\s+", text)]
        parts = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]
        k = int(len(parts) * ratio)
        k = len(parts) - 1 if k >= len(parts) else 1 if k <= 0 else k
        return "".join(parts[:k]), "".join(parts[k:])

    texts = ["A b.  C d!\nE? f", "One.", "", "x. y.\n", "no end here", "a.b.c. d"]
    for ratio in (0.0, 0.5, 0.7, 1.0):
        got = apply(spark, texts, X.split_at_ratio(V, ratio))
        assert [tuple(g) for g in got] == [py(t, ratio) for t in texts], ratio


def test_split_ratios_and_draws(spark):
    rows = spark.range(500).select(draws.split_ratios(F.col("id"), 3).alias("r"),
                                   draws.uniform_int(F.lit(5), F.lit(9), 3, "t", F.col("id")).alias("u")).collect()
    for r, u in rows:
        assert 0.15 <= r.beginning <= 0.25 and 0.30 <= r.middle_gap <= 0.50 and 0.4 <= r.mid_split <= 0.7
        assert 0.05 - 1e-9 <= r.end_start - r.beginning - r.middle_gap <= 0.15 + 1e-9
    assert {u for _, u in rows} == {5, 6, 7, 8, 9}
    again = spark.range(500).repartition(7).select("id", draws.uniform_int(F.lit(5), F.lit(9), 3, "t", F.col("id")).alias("u"))
    assert [r.u for r in sorted(again.collect())] == [u for _, u in rows]


def test_list_literals(spark):
    lists = [["a", "b'c", 'd"e', "f\\n", "g\n", "é\xa0", "'\"", "", "\x01x"], [], ["q"]]
    got = apply(spark, [repr(x) for x in lists], parsing.parse_list_literal(V))
    assert got == lists
    df = spark.createDataFrame([(["a'b", "c\\d", "e\nf"],)], "v array<string>")
    back = df.select(parsing.parse_list_literal(parsing.format_list_literal(V))).first()[0]
    assert back == ["a'b", "c\\d", "e\nf"]


def test_json_results(spark):
    good = '{"source":"x","ocr_transcript":"a","notes":"","fixed_transcript":"b"}'
    got = apply(spark, [good, "oops", good[:30], None], parsing.parse_ocr_json(V))
    assert tuple(got[0]) == ("x", "a", "", "b", None)
    assert got[1].error == "oops" and got[1].fixed_transcript is None
    assert got[2].error == good[:30]
    spell = apply(spark, ['{"spell_corrected_text":"t","correction_dict":{"a":"b"}}', "oops", None],
                  parsing.parse_spell_output(V))
    assert [tuple(s) for s in spell] == [("t", {"a": "b"}), ("", {}), ("", {})]


def test_clean_reply(spark):
    mark = parsing.ASSISTANT_MARK
    assert apply(spark, ["Q: A B \n"], parsing.clean_reply(V, "prefix", F.lit("Q:"))) == ["A B"]
    assert apply(spark, [f"p{mark}\n x {mark} y "], parsing.clean_reply(V, "assistant")) == ["y"]
    assert apply(spark, [' """a "b" c"" '], parsing.clean_reply(V, "quotes")) == ['a "b" c']
    replies = ["in ### RESPONSE: out ### RESPONSE: x", "no marker here at all"]
    assert apply(spark, replies, parsing.clean_reply(V, "response")) == ["out ### RESPONSE: x", replies[1]]


def test_hostile_texts_finish_quickly(spark):
    """Long runs that would be quadratic with careless patterns."""
    texts = [" " * 200_000 + "x", "(" * 200_000 + ")", "a" * 200_000 + "=", "a." * 100_000, "^" * 200_000]
    got = apply(spark, texts, F.length(X.strip_unclosed_paren(X.strip_stray_punct(X.remove_patterns(V)))),
                F.length(X.normalize_blank(V)), F.size(X.sentences(V)))
    assert got[0][1] == 1 and not math.isnan(got[3][0])
