"""Numbers by file, digest comparison, ledgers, jobs that go on, observed reports, CSV ranges, bucket folders."""

import os
import random

import pytest
from palimpsest.operators import compare, fields, profile, resumable, row_identity
from palimpsest.sources import csv, csv_ranges, ledger
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


# -- row numbers --------------------------------------------------------------------------


def test_file_numbers_are_dense_and_the_same_on_every_read(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id % 7 AS v").repartition(13).write.parquet(f"{tmp_path}/t")
    spark.range(0).selectExpr("id", "id % 7 AS v").write.mode("append").parquet(f"{tmp_path}/t")
    first = rows(row_identity.with_file_row_no(spark.read.parquet(f"{tmp_path}/t"), start=0), "id", "row_no")
    assert sorted(n for _, n in first) == list(range(5000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        numbered = row_identity.with_file_row_no(spark.read.parquet(f"{tmp_path}/t"), start=0)
        assert rows(numbered, "id", "row_no") == first
        assert "Sort [id" not in plan_of(numbered)[1] and "RDDScan" not in plan_of(numbered)[1]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_numbers_without_broadcast(spark, tmp_path, monkeypatch):
    spark.range(300).repartition(3).write.parquet(f"{tmp_path}/t")
    want = rows(row_identity.with_file_row_no(spark.read.parquet(f"{tmp_path}/t")))
    monkeypatch.setattr(row_identity, "BROADCAST_FILES", 0)
    assert rows(row_identity.with_file_row_no(spark.read.parquet(f"{tmp_path}/t"))) == want
    assert [n for _, n in sorted(want, key=lambda r: r[1])] == list(range(2, 302))


def test_sorted_numbers_checkpoint_keys_alone(spark):
    df = spark.range(500).selectExpr("nullif(id, 17) AS k", "repeat(string(id), 50) AS text").repartition(5)
    got = row_identity.with_row_no(df, ["k"], start=0)
    scanned = [line for line in plan_of(got)[1].split("\n") if "Scan ExistingRDD" in line]
    assert scanned and not any("text" in line for line in scanned)
    assert [r.k for r in sorted(got.collect(), key=lambda r: r.row_no)] == [None, *(i for i in range(500) if i != 17)]


def test_sorted_numbers_with_ties(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id", "'x' AS row")
    got = sorted((r.row_no, r.k, r.id) for r in row_identity.with_row_no(df, ["k"], start=1).collect())
    assert [n for n, _, _ in got] == list(range(1, 101)) and len({i for _, _, i in got}) == 100
    assert [k for _, k, _ in got] == sorted(k for _, k, _ in got)
    assert rows(row_identity.with_row_no(df.limit(0), ["k"])) == []


# -- comparison ---------------------------------------------------------------------------


def test_no_text_is_shuffled_for_the_summary(spark):
    a = spark.range(50).selectExpr("id AS row_no", "concat('text', id) AS mine")
    b = spark.range(50).selectExpr("id AS row_no", "concat('text', id % 40) AS theirs")
    out = compare.compare_column(a, b, "mine", "theirs")
    plan = out["summary"]._jdf.queryExecution().executedPlan().toString()
    tops = [line for line in plan.split("\n") if "Exchange" in line]
    assert tops and all("mine" not in line and "theirs" not in line for line in tops)
    digests = compare.reduced(a, "mine", ["row_no"])
    assert digests.columns == ["row_no", "digest", "stripped", "chars"]
    s = out["summary"].first()
    assert (s.exact_matches, s.total_differences) == (40, 10)
    assert rows(out["differences"])[0] == (40, "text40", "text0") and out["differences"].count() == 10


def test_comparison_by_keys(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a "), (None, "n"), (2, None)], "k int, t string")
    b = spark.createDataFrame([(7, "b"), (5, "a"), (6, None)], "k int, t string")
    out = compare.compare_column(a, b, "t", "t", order_by=["k"], start=1)
    s = out["summary"].first()
    assert (s.rows_a, s.rows_b, s.rows_match, s.exact_matches_overlap, s.nulls_a, s.nulls_b) == (4, 3, False, 0, 1, 1)
    # Numbers 1 to 4 are null, 1, 2, 3 on the left and 5, 6, 7 on the right.
    assert rows(out["differences"]) == [(1, "n", "a"), (2, "a ", None), (3, None, "b")]
    assert rows(out["samples"]) == [(1, "n", "a"), (2, "a ", None), (3, None, "b"), (4, "c", None)]


# -- ledger -------------------------------------------------------------------------------


def planned(spark, n):
    return spark.range(n).selectExpr("concat('p', id) AS path", "concat('u', id) AS img_url")


def test_ledger_survives_compaction_and_repeats(spark, tmp_path):
    folder, plan = f"{tmp_path}/ledger", planned(spark, 20)
    assert ledger.pending(plan, folder).count() == 20 and ledger.read(spark, folder).count() == 0
    ledger.append(plan.limit(8).unionByName(plan.limit(3)), folder, "a")
    ledger.append(spark.createDataFrame([(None,)], "path string"), folder, "b")
    left = rows(ledger.pending(plan, folder))
    assert len(left) == 12
    ledger.compact(spark, folder, files=2)
    assert rows(ledger.pending(plan, folder)) == left and ledger.read(spark, folder).count() == 8
    ledger.append(plan, folder, "c")
    assert ledger.pending(plan, folder).count() == 0
    # A generation whose write was lost does not count.
    os.makedirs(f"{folder}/generation=7")
    assert ledger.pending(plan, folder).count() == 0


def test_ledger_plan_is_one_join_without_a_listing(spark, tmp_path):
    ledger.append(planned(spark, 5), f"{tmp_path}/l", "a")
    plan = plan_of(ledger.pending(planned(spark, 9), f"{tmp_path}/l"))[0]
    assert plan.count("Join LeftAnti") == 1 and "binaryFile" not in plan


def test_a_second_run_fetches_nothing_new(spark, tmp_path):
    log, down = tmp_path / "log", tmp_path / "down"
    down.write_text("")

    def make_fetch(log=str(log), down=str(down)):
        def fetch(pairs):
            if os.path.exists(down) and any(u.endswith("3") for u, _ in pairs):
                raise OSError("refused")
            with open(log, "a") as out:
                out.writelines(f"{u}\n" for u, _ in pairs)
            return [None] * len(pairs)

        return fetch

    plan, folder = planned(spark, 30), f"{tmp_path}/l"
    failed = ledger.fetch_pending(plan.unionByName(plan.limit(4)), folder, make_fetch, "first")
    assert rows(failed) == [(f"p{i}", "refused") for i in (13, 23, 3)]
    down.unlink()
    assert ledger.fetch_pending(plan, folder, make_fetch, "second").count() == 0
    assert ledger.fetch_pending(plan, folder, make_fetch, "third").count() == 0
    assert sorted(log.read_text().split()) == sorted(f"u{i}" for i in range(30))


# -- resumable generation -----------------------------------------------------------------


def counting(log, broken):
    def make():
        def fn(batch):
            if any(broken(p) for p in batch):
                raise RuntimeError("lost")
            with open(log, "a") as out:
                out.writelines(f"{p}\n" for p in batch)
            return [p.upper() for p in batch]

        return fn

    return make


def test_a_job_goes_on_with_what_is_missing(spark, tmp_path):
    log, folder = f"{tmp_path}/log", f"{tmp_path}/replies"
    # One prompt is a third of all rows.
    df = spark.range(90).selectExpr("id", "if(id % 3 = 0, 'same', if(id = 1, null, concat('q', id))) AS p")
    n = df.where("p IS NOT NULL").select("p").distinct().count()
    half = counting(log, lambda p: p[-1] in "02468e")
    assert resumable.ask_missing(df, "p", half, folder, num_samples=2) == 2 * n
    asked = len(open(log).read().split())
    assert 0 < asked < 2 * n
    every = counting(log, lambda p: False)
    assert resumable.ask_missing(df, "p", every, folder, num_samples=2, batches=3, partitions=2) == 2 * n - asked
    assert resumable.ask_missing(df, "p", every, folder, num_samples=2) == 0
    calls = open(log).read().split()
    assert len(calls) == 2 * n and calls.count("same") == 2
    got = rows(resumable.with_replies(df, "p", folder, 2), "id", "sample", "p", "response", "error")
    want = [(r.id, s, r.p, r.p and r.p.upper(), None) for r in df.collect() for s in (1, 2)]
    assert got == sorted(want, key=repr)


def test_failures_are_asked_a_bounded_number_of_times(spark, tmp_path):
    df = spark.createDataFrame([("bad",), ("fine",)], "p string")
    make = counting(f"{tmp_path}/log", lambda p: p == "bad")
    asked = [resumable.ask_missing(df, "p", make, f"{tmp_path}/r", attempts=2) for _ in range(3)]
    assert asked == [2, 1, 0]
    assert rows(resumable.with_replies(df, "p", f"{tmp_path}/r"), "p", "response", "error") == [("bad", None, "lost"), ("fine", "FINE", None)]


def test_a_lost_write_is_asked_again(spark, tmp_path):
    folder = f"{tmp_path}/r"
    os.makedirs(f"{folder}/asked-0/_temporary")
    df = spark.createDataFrame([("a",)], "p string")
    assert resumable.ask_missing(df, "p", counting(f"{tmp_path}/log", lambda p: False), folder) == 1
    assert resumable.with_replies(df, "p", folder).first().response == "A"


# -- reports and buckets ------------------------------------------------------------------


def test_report_scans_the_details_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    flagged = F.udf(lambda i: calls.add(1) or i % 3 == 0, "boolean").asNondeterministic()
    details = spark.range(60).withColumn("has_messy", flagged("id"))
    profile.write_report(details, f"{tmp_path}/r")
    assert calls.value == 60
    assert rows(spark.read.parquet(f"{tmp_path}/r/summary")) == [
        ("Clean Rows", "40"), ("Messy Rows", "20"), ("Percent Messy", "33.3%"), ("Total Rows", "60")
    ]
    assert spark.read.parquet(f"{tmp_path}/r/metadata").count() == 60
    profile.write_report(details.limit(0), f"{tmp_path}/none")
    assert ("Total Rows", "0") in rows(spark.read.parquet(f"{tmp_path}/none/summary"))


def test_buckets_are_written_once_and_read_apart(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((0, 1, 5, 6, 20, 21, 90))], "i int, t string")
    fields.write_by_bucket(df, "t", f"{tmp_path}/b")
    parts = fields.bucket_tables(spark, f"{tmp_path}/b")
    assert {b: p.count() for b, p in parts.items()} == {"empty": 1, "1-5": 2, "6-20": 2, "over_20": 2}
    assert all("PartitionFilters: [isnotnull(bucket" in plan_of(p)[1] for p in parts.values())
    counted = fields.bucket_counts(df.where("i > 2"), "t")
    assert rows(counted) == [("1-5", 0), ("6-20", 2), ("empty", 0), ("over_20", 2)]
    assert plan_of(counted)[0].count("LogicalRDD") <= 1


# -- CSV ranges ---------------------------------------------------------------------------


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ranges_equal_the_plain_read(spark, tmp_path, small_ranges):
    draw = random.Random(8)
    cells = ["a", "", 'say "hi"', "two\nlines", "\n", "x,y", "r\r\nn", " é ", '""', "long " * 300, "many\n" * 400, None]
    made = [(i, draw.choice(cells), draw.choice(cells)) for i in range(400)]
    df = spark.createDataFrame(made, "i int, t string, u string")
    csv.write_items_csv(df.coalesce(1), f"{tmp_path}/c")
    plain = csv.read_items_csv(spark, f"{tmp_path}/c", df.schema)
    cut = csv.read_items_csv(spark, f"{tmp_path}/c", df.schema, by_ranges=True)
    assert csv_ranges._lines(spark, f"{tmp_path}/c").rdd.getNumPartitions() > 50
    assert rows(cut) == rows(plain) and cut.count() == 400
    csv.write_items_csv(df.repartition(3), f"{tmp_path}/d", quote_all=False)
    assert rows(csv.read_items_csv(spark, f"{tmp_path}/d", df.schema, by_ranges=True)) == rows(csv.read_items_csv(spark, f"{tmp_path}/d", df.schema))


def test_ranges_without_broadcast_and_with_carriage_returns(spark, tmp_path, small_ranges, monkeypatch):
    body = "i,t\r\n" + "".join(f'{i},"a\r\n""{i}"" b"\r\n' for i in range(200)) + "\r\n7,end"
    (tmp_path / "f.csv").write_bytes(body.encode())
    monkeypatch.setattr(csv_ranges, "BROADCAST_RANGES", 0)
    got = rows(csv.read_items_csv(spark, f"{tmp_path}/f.csv", "i int, t string", by_ranges=True))
    assert got == sorted([*((i, f'a\r\n"{i}" b') for i in range(200)), (7, "end")], key=repr)


def test_unpaired_quotes_are_an_error(spark, tmp_path):
    (tmp_path / "f.csv").write_text('t\n"a"\nb"\n')
    with pytest.raises(Exception, match="unpaired quotes"):
        csv_ranges.records(spark, f"{tmp_path}/f.csv").collect()
    (tmp_path / "g.csv").write_text("t\n")
    assert csv_ranges.records(spark, f"{tmp_path}/g.csv").count() == 0
