"""Table operators on small rows that hold the null, duplicate and boundary cases."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from palimpsest.operators import (
    clean, compare, evaluate, fields, generate, joins, profile, prompts, quality, row_identity, tasks,
)
from palimpsest.plans import cleaning, datasets, evaluation
from palimpsest.session import work_path
from palimpsest.sources import csv, manifests, schema, tables


# The stub model below is sent to workers, which cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# -- sources ------------------------------------------------------------------------------


def test_csv_round_trip(spark):
    data = [(1, 'say "hi"\nback\\slash', ""), (2, " lead, trail ", "a\r\nb"), (3, None, "x")]
    df = spark.createDataFrame(data, "id long, text string, note string")
    for quote_all in (True, False):
        path = work_path(spark, "csv")
        csv.write_items_csv(df.coalesce(1), path, quote_all=quote_all)
        back = {r.id: r for r in csv.read_items_csv(spark, path, df.schema).collect()}
        assert back[1].text == data[0][1] and back[2].text == data[1][1] and back[2].note == data[1][2]
        assert not back[3].text  # null and '' look the same in a file


def test_csv_of_the_item_table(spark, tmp_path):
    header = ",".join(f'"{h}"' for h in schema.ITEM_HEADERS)
    cells = {"Title": "A title", "Transcript": 'two ""quoted""\nlines \\\\ end', "CONTENTdm number": "42"}
    line = ",".join(f'"{cells.get(h, "")}"' for h in schema.ITEM_HEADERS)
    (tmp_path / "items.csv").write_text(header + "\n" + line + "\n", encoding="utf-8")
    row = csv.read_items_csv(spark, str(tmp_path), undouble_backslashes=True).first()
    assert (row.title, row.item_number, row.oclc_number) == ("A title", 42, None)
    assert row.transcript == 'two "quoted"\nlines \\ end'


def test_attach_without_fan_out(spark):
    main = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, i int")
    right = spark.createDataFrame([(None, "x", 1), (None, "y", 2), ("a", "z", 1)], "k string, v string, o int")
    assert joins.attach(main, right, "k", ["v"]).count() == 5
    got = joins.attach(main, right, "k", ["v"], last_by="o")
    assert sorted((r.i, r.v) for r in got.collect()) == [(1, "y"), (2, "y"), (3, "z")]


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('b,other,a\n"2",x,"1"\n', encoding="utf-8")
    assert rows(csv.read_items_csv(spark, str(tmp_path), "a int, b int")) == [(1, 2)]
    with pytest.raises(ValueError, match="missing"):
        csv.read_items_csv(spark, str(tmp_path), "a int, c int")


def test_override_keeps_rows_with_null_keys(spark):
    main = spark.createDataFrame([(None if i % 3 == 0 else f"k{i % 5}", i, "old") for i in range(60)], "k string, i int, v string")
    manual = spark.createDataFrame([("k1", "new", 1), (None, "none", 2)], "k string, v string, o int")
    got = joins.override_values(main, manual, "k", "v", "o")
    assert got.columns == ["k", "i", "v", "overridden"] and got.count() == 60
    assert {(r.k, r.v, r.overridden) for r in got.collect()} >= {(None, "old", False), ("k1", "new", True), ("k2", "old", False)}


def test_scores_share_one_exchange_with_python(spark):
    df = spark.createDataFrame([("a b c", "a c")], "answer string, response string")
    plan = evaluate.score(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_csv_prints_lists(spark):
    path = work_path(spark, "csv")
    df = spark.createDataFrame([(1, ["l", "o'x"])], "id int, artifacts array<string>")
    csv.write_items_csv(df, path)
    assert csv.read_items_csv(spark, path, "id int, artifacts string").first()[1] == "['l', 'o\\'x']"


def test_tables_and_json(spark):
    folder = work_path(spark, "tables")
    df = spark.createDataFrame([(1, "é", None)], "id int, result string, error string")
    tables.write_tables({"a": df, "b": df.select("id")}, folder)
    assert spark.read.parquet(folder + "/b").columns == ["id"]
    tables.write_json(df, folder + "/json")
    text = spark.read.text(folder + "/json").first()[0]
    assert text == '{"id":1,"result":"é"}'


def test_required_columns_and_schema_diff(spark):
    a, b = spark.range(1), spark.range(1).select("id", F.lit("x").alias("new"))
    with pytest.raises(ValueError, match="missing"):
        tables.require_columns(a, ["id", "title"])
    with pytest.warns(UserWarning):
        assert tables.require_columns(a, ["title"], on_missing="warn") == ["title"]
    assert rows(tables.schema_diff(a, b)) == [("new", "string")]


def test_variant_tables(spark):
    df = spark.createDataFrame([(1, "o", "s")], "id int, original string, semi string")
    parts = tables.variant_tables(df, {"o": "original", "s": "semi"})
    assert parts["all"].columns == ["id", "original", "semi"]
    assert rows(parts["s"]) == [(1, "s")] and parts["s"].columns == ["id", "transcript"]


def test_page_plan_and_pending(spark, tmp_path):
    canvas = '{"images":[{"resource":{"service":{"@id":"http://h/%d"}}}]}'
    body = '{"sequences":[{"canvases":[%s,%s]},{"canvases":[%s]}]}' % tuple(canvas % i for i in (1, 2, 3))
    plan = manifests.plan_page_images(spark.createDataFrame([(7, body)], "item_id long, manifest string"), "d/c/")
    assert rows(plan) == [
        (7, 1, "http://h/1/full/pct:100/0/default.jpg", "d/c/7/7_page1.jpg"),
        (7, 2, "http://h/2/full/pct:100/0/default.jpg", "d/c/7/7_page2.jpg"),
    ]
    existing = spark.createDataFrame([("d/c/7/7_page1.jpg",)] * 2, "path string")
    assert rows(manifests.pending_pages(plan, existing), "page") == [(2,)]
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "7_page1.jpg").write_bytes(b"x")
    (tmp_path / "7" / "note.txt").write_bytes(b"x")
    found = manifests.existing_files(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["7_page1.jpg"]
    url = spark.range(1).select(manifests.manifest_url("http://h/", "coll", F.lit(5.0))).first()[0]
    assert url == "http://h/iiif/info/coll/5/manifest.json"


# -- joins and row identity ---------------------------------------------------------------


def keyed(spark, keys):
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k int")


def test_null_keys_match_in_restrict_and_attach(spark):
    left = keyed(spark, [1, None, 2, None])
    right = spark.createDataFrame([(None, "n"), (1, "x"), (1, "y")], "k int, v string")
    assert joins.restrict_to(left, right, "k").count() == 3
    got = rows(joins.attach(left, right, "k", ["v"]), "i", "v")
    assert got == [(0, "x"), (0, "y"), (1, "n"), (2, None), (3, "n")]


def test_override_last_wins_and_nulls_are_ignored(spark):
    main = spark.createDataFrame([("A", "a"), ("B", "b"), (None, "c")], "title string, text string")
    manual = spark.createDataFrame(
        [("A", "x", 1), ("A", "y", 2), ("A", None, 3), (None, "z", 4)], "title string, text string, row_no int"
    )
    got = rows(joins.override_values(main, manual, "title", "text", "row_no"))
    assert got == [("A", "y", True), ("B", "b", False), (None, "c", False)]


def test_missing_keys_and_updated_sample(spark):
    main = spark.createDataFrame([(1, "A", "t" * 120), (2, "B", "u"), (3, None, "v")], "n int, title string, text string")
    manual = spark.createDataFrame([("A", "x"), ("C", "y"), ("C", "z"), (None, "q")], "title string, text string")
    assert rows(joins.missing_keys(manual, main, "title")) == [("C",)]
    assert rows(joins.updated_sample(main, manual, "title", "text", "n")) == [(1, "A", "t" * 100 + "...")]


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).repartition(7).withColumn("hot", F.col("id") < 700)
    got = row_identity.with_row_no(df, ["hot", "id"])
    pairs = sorted((r.row_no, r.hot, r.id) for r in got.collect())
    assert [p[0] for p in pairs] == list(range(2, 1002))
    assert [p[1:] for p in pairs] == sorted(p[1:] for p in pairs)


def test_scan_order_numbers_and_zip(spark):
    a = row_identity.with_row_no(spark.createDataFrame([("x",), ("y",)], "a string").coalesce(1), start=0)
    b = row_identity.with_row_no(spark.createDataFrame([("p",), ("q",), ("r",)], "b string").coalesce(1), start=0)
    assert rows(row_identity.zip_rows(a, b)) == [(0, "x", "p"), (1, "y", "q"), (2, None, "r")]
    with pytest.raises(ValueError):
        row_identity.zip_rows(a, a)


def test_find_rows_reports_duplicates(spark):
    main = spark.createDataFrame([("A", 0), ("B", 1), ("A", 2), (None, 3)], "title string, row_no int")
    subset = spark.createDataFrame([("A",), ("A",), (None,)], "title string")
    assert rows(joins.find_rows(subset, main, "title")) == [("A", 0, 2), ("A", 2, 4)]
    assert rows(joins.find_rows(subset, main, "title", base=1), "row_number") == [(1,), (3,)]


def test_duplicates_with_a_hot_key(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 100, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    nulls = spark.createDataFrame([(900, None), (901, None)], "id long, k string")
    assert joins.duplicate_rows(df.unionByName(nulls), "k").count() == 102
    assert joins.count_distinct(df.unionByName(nulls), "k").first()[0] == 201


# -- fields -------------------------------------------------------------------------------


def test_year_filters(spark):
    df = spark.createDataFrame([("1939",), ("1940",), ("1950",), ("1951",), ("",), (None,)], "year string")
    assert rows(fields.filter_years(df, *fields.FORTIES)) == [("1940",), ("1950",)]
    assert rows(fields.filter_years(df, *fields.FORTIES_STRICT)) == [("1950",)]


def test_filters_and_fixups(spark):
    df = spark.createDataFrame(
        [("t", "x" * 30), ("", "x" * 40), (None, "x" * 40), ("t", "x" * 29), ("t", None)], "title string, transcript string"
    )
    assert fields.filter_trainable(df).count() == 1
    text = spark.createDataFrame([("a",), (" \n",), (None,)], "t string")
    assert rows(fields.to_text(text, "t")) == [("a",)]
    assert fields.to_text(text, "t", keep_blank=True).count() == 2
    doors = spark.createDataFrame([("1022 Wayne",), ("at 1022 W",)], "t string")
    assert rows(fields.apply_fixups(doors, "t")) == [("1022½ Wayne",), ("at 1022 W",)]
    keys = spark.createDataFrame([(1.0,), (None,)], "k double")
    assert rows(fields.drop_null_keys(keys, "k")) == [(1,)]
    empty = spark.createDataFrame([(None, None), (1, None)], "a int, b string")
    assert fields.all_null_rows(empty).count() == 1


def test_buckets_partition_the_table(spark):
    df = spark.createDataFrame([(t,) for t in ("", "ab", "x" * 10, "y" * 30, None)], "t string")
    counts = {k: d.count() for k, d in fields.split_by_bucket(df, "t").items()}
    assert counts == {"empty": 2, "1-5": 1, "6-20": 1, "over_20": 1}
    path = work_path(spark, "buckets")
    fields.write_by_bucket(df, "t", path)
    assert spark.read.parquet(path).where("bucket = 'empty'").count() == 2


# -- profile and clean --------------------------------------------------------------------

ITEMS = [
    (1, None), (2, ""), (3, "a" * 2 + "b" * 17), (4, "ab" * 10), (5, "Helllo wooorld this is AT&T x"),
    (6, "plain words in a sentence of some length."), (7, "©© and c@d with Helllo (never closed"),
]


def profiled(spark):
    df = spark.createDataFrame(ITEMS, "id int, transcript string")
    return cleaning.clean_items(df, date=None)


def test_profile_rows(spark):
    got = {r.id: r for r in profiled(spark).collect()}
    assert [got[i].short_transcript for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert got[1].issue_types == ["Empty Transcript"] and got[2].issue_types == ["Empty Transcript"]
    assert got[3].issue_types == ["Repeat Chars", "Low Char Count"]
    assert got[5].issue_types == ["Repeat Chars"] and got[5].detected_artifacts == ["l", "o"]
    assert got[7].issue_types == ["Special Char Artifacts", "General Artifacts", "Repeat Chars"]
    assert got[7].detected_artifacts == ["©©", "c@d", "l"]
    for r in got.values():
        assert r.quality == (r.issue_types == [])
        assert r.semi_clean_transcript is not None


def test_semi_clean_routes(spark):
    got = {r.id: r.semi_clean_transcript for r in profiled(spark).collect()}
    assert got[1] == "" and got[3] == ""
    assert got[4] == "ab" * 10 and got[6] == ITEMS[5][1]
    assert got[5] == "l o this is  x".replace("  ", " ")
    assert got[7] == " and with l "


def test_order_b_has_no_gate(spark):
    df = spark.createDataFrame([("©© aaa",)], "transcript string")
    assert clean.semi_clean_messy(df).first()[1] == " a"


def test_flag_reports(spark):
    texts = ["plain", "c@d e", "©©", "Helllo", "©© Helllo"]
    df = profile.messy_columns(spark.createDataFrame([(t,) for t in texts], "transcript string"))
    s = profile.messy_summary(df).first()
    assert (s.total_rows, s.messy_rows, s.special_messy_rows, s.repeat_rows) == (5, 1, 2, 2)
    assert (s.messy_percent, s.special_messy_percent) == (20.0, 40.0)
    assert dict((r[0], r[1:]) for r in rows(profile.flag_breakdown(df)))["any_messy"] == (4, 1)
    assert rows(profile.flag_overlap(df)) == [
        ("General Only", 1), ("Multi-Type", 1), ("Repeat Only", 1), ("Special Only", 1)
    ]
    assert dict(rows(profile.summary_table(df)))["Percent Messy"] == "20.0%"
    assert rows(profile.top_sequences(df, "special_messy_sequences", 5)) == [("©©", 2)]
    assert df.where("has_messy").first().total_messy_chars == 3
    flags = profile.pattern_flags(df.select("transcript"), "transcript").collect()
    full = df.collect()
    assert [(r.special_pattern, r.general_pattern, r.repeat_chars) for r in flags] == [
        (r.has_special_messy, r.has_messy, r.has_repeat_sequence) for r in full
    ]
    example = fields.example_rows(df.withColumn("n", F.monotonically_increasing_id()), "has_messy", "messy_sequences", "transcript", 3, "n")
    assert example.first().preview == "c@d e..." and example.first().sequence_count == 1


def test_empty_summary(spark):
    df = profile.messy_columns(spark.createDataFrame([], "transcript string"))
    assert profile.messy_summary(df).first().total_rows == 0
    assert dict(rows(profile.summary_table(df)))["Percent Messy"] == "0.0%"


def test_type_and_empty_counts(spark):
    kinds = ["Text", "STILL IMAGE", "still image; text", None, "map"]
    df = spark.createDataFrame([(k,) for k in kinds], "type string")
    assert tuple(profile.type_counts(df).first()) == (1, 1, 1, 2, 5)
    blanks = spark.createDataFrame([(None, "x"), (" \t", "y"), ("z", "")], "a string, b string")
    assert rows(profile.empty_counts(blanks, ["a", "b"])) == [("a", 2), ("b", 1)]


# -- compare ------------------------------------------------------------------------------


def numbered(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_no int, t string")


def test_compare_equal_counts(spark):
    a = numbered(spark, ["x", None, "p ", "d – e", "same"])
    b = numbered(spark, ["x", None, "p", "d - e", "same"])
    out = compare.compare_column(a, b, "t", "t")
    s = out["summary"].first()
    assert (s.rows_a, s.rows_match, s.exact_matches, s.exact_match_rate, s.total_differences) == (5, True, 3, 0.6, 2)
    assert s.exact_matches_overlap is None
    assert s.potential_issues == ["whitespace differences", "only one side has: –"]
    assert rows(out["differences"]) == [(2, "p ", "p"), (3, "d – e", "d - e")]
    assert out["samples"].count() == 5


def test_compare_unequal_counts(spark):
    s = compare.compare_column(numbered(spark, ["x", "y ", None]), numbered(spark, ["x", "y"]), "t", "t")["summary"].first()
    assert (s.rows_match, s.exact_matches, s.exact_matches_overlap, s.exact_match_rate_overlap) == (False, None, 1, 0.5)
    assert s.potential_issues == ["null counts differ"]
    with pytest.raises(ValueError):
        compare.compare_column(numbered(spark, ["x"]), numbered(spark, ["x"]), "t", "nope")


# -- quality ------------------------------------------------------------------------------

GOOD = "the man was on the road and he had not been in town for one day as they were with him at home"


def test_quality_reasons(spark):
    cases = {
        "blank": " \n",
        "too_few_words": "the " * 19,
        "single_chars": "a b c d e f g h i j k l " + GOOD,
        "non_alpha": "12, 34, x5 6. 7: 8; 9! 10 " * 3 + "the road and he had not been in town for one day",
        "short_words": "ab to of in is it he on as at be or by we to of in is it he",
        "low_variety": "the road and " * 10,
        "few_common_words": " ".join(f"w{chr(97 + i)}{chr(98 + i)}long" for i in range(22)),
        "": GOOD,
    }
    df = spark.createDataFrame(list(cases.items()), "want string, t string")
    got = {r.want: (r.fail_reason or "", r.quality_transcript) for r in quality.high_quality(df, "t").collect()}
    assert got == {k: (k, k == "") for k in cases}
    assert quality.high_quality(spark.createDataFrame([(None,)], "t string"), "t").first().fail_reason == "blank"
    c = profile.quality_counts(quality.high_quality(df, "t")).first()
    assert (c.passed, c.failed) == (1, len(cases) - 1)


def test_quality_with_dictionary(spark):
    df = spark.createDataFrame([(1, GOOD), (2, GOOD.replace("road", "rxad")), (3, "the road and " * 10)], "id int, t string")
    known = [(w,) for w in set(GOOD.split())]
    full = spark.createDataFrame(known, "word string")
    got = rows(quality.high_quality(df, "t", full, "id"), "id", "fail_reason")
    assert got == [(1, None), (2, None), (3, "low_variety")]
    poor = spark.createDataFrame([("the",)], "word string")
    got = rows(quality.high_quality(df, "t", poor, "id"), "id", "fail_reason")
    assert got == [(1, "misspelled"), (2, "misspelled"), (3, "low_variety")]


# -- tasks and generation -----------------------------------------------------------------


def test_completion_tasks(spark):
    words = [f"w{i}" for i in range(60)]
    data = [(1, "T", " ".join(words[:19]), 1948), (2, "T", "  " + "  ".join(words[:20]), 1948),
            (3, None, " ".join(words), None), (4, "T", None, 1948)]
    df = spark.createDataFrame(data, "original_index int, title string, transcript string, year int")
    got = tasks.completion_tasks(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.original_index, {})[r.task_type] = r
    assert {k: len(v) for k, v in by.items()} == {2: 4, 3: 4}
    assert rows(tasks.skipped_documents(df)) == [(1, 19, "too short"), (4, 0, "no transcript")]
    m = by[3]["missing_middle"]
    first, final = m.input.split(":\n", 1)[1].split("... [this text is missing]... ")
    middle = m.output.split(":\n\n", 1)[1]
    assert f"{first} {middle} {final}".split() == words
    assert 12 <= len(first.split()) <= 21 and 5 <= len(middle.split()) <= 30 and len(final.split()) >= 5
    half = by[3]["complete_first_half"]
    assert (half.output.split("\n\n", 1)[1] + " " + half.input.split("...", 1)[1]).split() == words
    assert by[2]["complete_full"].output == 'This is the complete transcript for "T":\n\n' + "  ".join(words[:20])
    assert by[2]["contextual_completion"].input.startswith('Based on the year, 1948, and title, "T", complete')
    assert by[3]["contextual_completion"].input.startswith('Based on the year, , and title, "", complete')


def test_training_text_and_prompts(spark):
    df = spark.createDataFrame([("T", "x y", "i", "o")], "title string, transcript string, input string, output string")
    assert tasks.training_text(df).first().text == "### TITLE: T\n### TRANSCRIPT:\nx y\n### RESPONSE: x y"
    assert tasks.training_text(df, "io").first().text == "### INPUT:i\n### RESPONSE: o"
    p = {t: prompts.build_prompts(df, "title", t).first().prompt for t in (*prompts.TEMPLATES, "messages")}
    assert p["qa"] == prompts.DEFAULT_SYSTEM + "\n\nQuestion: T\nAnswer:"
    assert p["examples"].endswith("\nAnswer: 1776\n\nQuestion: T\nAnswer:") and "helpful" not in p["examples"]
    assert p["restore"].endswith('TEXT TO CORRECT:\n"""\nT\n"""\n<|assistant|>\n')
    assert 'Text:\n"""T"""' in p["proofread"]
    assert [tuple(m) for m in p["messages"]] == [("system", prompts.DEFAULT_SYSTEM), ("user", "T")]
    with pytest.raises(ValueError):
        prompts.build_prompts(df, "title", "nope")


def test_chunks(spark):
    df = spark.createDataFrame([(1, " a b  c d e "), (2, ""), (3, None), (4, "x")], "id int, t string")
    chunks = tasks.chunk_words(df, "t", 2)
    assert rows(chunks) == [(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e"), (4, 0, "x")]
    assert rows(tasks.join_chunks(chunks, "id")) == [(1, "a b c d e"), (4, "x")]


def flaky():
    def fn(batch):
        if any("bad" in p for p in batch):
            raise RuntimeError("no")
        return [p.upper() for p in batch]

    return fn


def test_generate_isolates_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c"), (4, None)], "id int, p string").coalesce(1)
    out = generate.generate(df, "p", flaky, num_samples=2, partitions=2, key="id")
    got = rows(out, "id", "sample", "response", "error")
    assert got == [(1, 1, "A", None), (1, 2, "A", None), (2, 1, None, "no"), (2, 2, None, "no"),
                   (3, 1, "C", None), (3, 2, "C", None), (4, 1, None, None), (4, 2, None, None)]
    status = generate.job_status(out).first()
    assert (status.succeeded, status.failed) == (6, 2)
    wide = generate.widen_responses(out, ["id"], 2)
    assert rows(wide) == [(1, "A", "A"), (2, None, None), (3, "C", "C"), (4, None, None)]


def test_wrong_reply_count_is_an_error(spark):
    df = spark.createDataFrame([("a",)], "p string")
    out = generate.generate(df, "p", lambda: (lambda batch: []), batch_size=5).first()
    assert out.response is None and "0 replies" in out.error


def test_correct_columns(spark):
    df = spark.createDataFrame([("a", None), (" ", "bad"), (None, "x")], "t string, u string")
    with pytest.warns(UserWarning):
        out = generate.correct_columns(df, ["t", "u", "nope"], flaky)
    assert rows(out) == [(" ", "bad", " ", "bad"), ("a", None, "A", None), (None, "x", None, "X")]


def test_partial_apply(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    out = generate.partial_apply(df, F.col("t") == "a", lambda d: d.withColumn("c", F.upper("t")))
    assert rows(out) == [("a", "A"), (None, None)]


def test_pack_tokens(spark):
    df = spark.createDataFrame([([5, 6],), ([1, 2, 3, 4],), ([],)], "tokens array<int>")
    got = [tuple(r)[1:] for r in generate.pack_tokens(df, "tokens", 3, pad_id=9).collect()]
    assert got == [([5, 6, 9], [1, 1, 0], [5, 6, 9]), ([1, 2, 3], [1, 1, 1], [1, 2, 3]), ([9, 9, 9], [0, 0, 0], [9, 9, 9])]
    loose = [r.input_ids for r in generate.pack_tokens(df, "tokens", 3, pad=False).collect()]
    assert loose == [[5, 6], [1, 2, 3], []]
    texts = spark.createDataFrame([("ab",), (None,)], "t string")
    ids = generate.token_ids(texts, "t", lambda: (lambda batch: [[ord(c) for c in t] for t in batch]))
    assert [r.tokens for r in ids.collect()] == [[97, 98], []]


# -- evaluation ---------------------------------------------------------------------------


def test_correction_metrics(spark):
    df = spark.createDataFrame([("Tke Board oi", "The board [oi] of it"), (None, "x"), ("", "a")], "o string, c string")
    with pytest.warns(UserWarning):
        out = evaluate.correction_metrics(df, ["o", "o"], ["c", "nope"])
    got = [tuple(r)[:5] for r in out.collect()]
    assert got == [(3, 5, 3, 100.0, 1), (0, 0, 0, 0.0, 0), (0, 1, 1, 0.0, 0)]
    with pytest.raises(ValueError):
        evaluate.correction_metrics(df, ["o"], [])


def test_correction_metrics_search_each_original_once(spark):
    rows = [(1, "A b, b", "A b, b", "A [b] c"), (2, None, "x", None), (3, "[x] y", "[x] y", ""), (4, "", "", "z")]
    df = spark.createDataFrame(rows, "id long, o string, same string, other string")
    out = evaluate.correction_metrics(df, ["o", "o"], ["same", "other"], keys=["id"])
    searched = out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lower(o#")
    assert searched == 1
    found = {(r[0], r["corrected_column"]): tuple(r)[1:6] for r in out.collect()}
    assert found == {
        (1, "same"): (2, 2, 0, 0.0, 0),
        (1, "other"): (2, 3, 1, 50.0, 1),
        (2, "same"): (0, 0, 0, 0.0, 0),
        (2, "other"): (0, 0, 0, 0.0, 0),
        (3, "same"): (2, 2, 0, 0.0, 1),
        (3, "other"): (2, 0, 0, 0.0, 0),
        (4, "same"): (0, 0, 0, 0.0, 0),
        (4, "other"): (0, 1, 1, 0.0, 0),
    }


def test_accuracy_and_consistency(spark):
    df = spark.createDataFrame(
        [("q", "the cat sat", "the cat sat", "a dog")], "question string, answer string, response_1 string, response_2 string"
    )
    scores, means = evaluation.accuracy(df)
    by = {r.model: r for r in scores.collect()}
    r = by["response_1"]
    assert (r.bleu, r.rouge_l, r.jsd, r.jaccard, r.levenshtein) == (1.0, 1.0, 0.0, 1.0, 1.0)
    r = by["response_2"]
    assert (r.bleu, r.jaccard) == (0.0, 0.0) and r.jsd == pytest.approx(1.0)
    assert means.count() == 2 * len(evaluate.METRICS)
    _, means = evaluation.consistency(df)
    assert {r.model for r in means.collect()} == {"response_2"}


def test_dataset_plans(spark):
    df = spark.createDataFrame([("q1", "a1"), ("q2", "a2")], "question string, answer string")
    out = datasets.answer_questions(df, flaky, num_samples=2, template="chat")
    assert out.columns == ["question", "answer", "response_1", "response_2"] and out.count() == 2
    same = datasets.answer_questions(df.union(df).union(df.limit(1)), flaky, num_samples=2)
    assert same.count() == 5 and "Exchange hash" not in same._jdf.queryExecution().toString()
    years = spark.createDataFrame([(1, "a", "1939"), (2, "b", "1945")], "item_number int, original_transcript string, year string")
    kept, ids = datasets.select_years(years)
    assert kept.count() == 1 and ids.columns == ["item_number", "original_transcript"]
    manual = spark.createDataFrame([(2, "clean")], "item_number int, clean_transcript string")
    merged = datasets.merge_variants(years, manual, "item_number", ["item_number", "original_transcript"])
    assert rows(merged) == [(2, "b", "clean")]


def test_scores_hold_few_rows_as_objects(spark, monkeypatch):
    import pyarrow as pa
    from palimpsest.functions import scores as S

    seen = []

    def count(u, v):
        seen.append(len(u))
        return [len(x) + len(y) for x, y in zip(u, v)]

    a, b = pa.array(["a" * (i % 7) for i in range(1000)]), pa.array(["b"] * 1000)
    assert S.sliced(count, a, b, pa.int32()).to_pylist() == [i % 7 + 1 for i in range(1000)]
    assert max(seen) <= S.SLICE and sum(seen) == 1000
    assert S.sliced(count, a[:0], b[:0], pa.int32()).to_pylist() == []
