"""Every operator as a named query over the shared test tables.

``documents`` plays the item table: ``doc_id`` is the item number, ``text`` the
transcript, ``labels`` marks the manually cleaned subset, ``conversations`` holds
questions and answers, ``benchmark`` is the dictionary corpus and ``pages`` the scanned
items.  All queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import draws, parsing
from palimpsest.functions import text as X
from palimpsest.operators import (
    clean,
    compare,
    evaluate,
    fields,
    generate,
    joins,
    profile,
    prompts,
    quality,
    resumable,
    row_identity,
    spelling,
    tasks,
)
from palimpsest.plans import cleaning, datasets
from palimpsest.session import spread, work_path
from palimpsest.sources import csv, ledger, manifests, tables
from palimpsest.streaming.incremental import clean_new_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LIST_MARK = "¦"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- inputs -------------------------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(tables.load_table(spark, sf, "documents"), "doc_id")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return tables.load_table(spark, sf, "labels")


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.build_vocabulary(tables.load_table(spark, sf, "benchmark"), ["text"])


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a title (one for each whole text, null for short ones), type and year."""
    text = F.col("text")
    return documents(spark, sf).select(
        "doc_id",
        F.when(F.length(text) >= 40, F.concat(F.lit("Item "), F.md5(text))).alias("title"),
        F.when(F.col("lang") == "en", "Text")
        .when(F.col("lang") == "fr", "STILL IMAGE")
        .when(F.col("lang") == "de", "still image; text")
        .alias("type"),
        (F.lit(1935) + F.col("doc_id") % 20).alias("year"),
        text.alias("transcript"),
        "source",
    )


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose transcripts are of every length: the whole text, or another whole column."""
    kept = items(spark, sf)
    return kept.withColumn(
        "transcript",
        F.when(F.col("type") == "Text", F.col("transcript"))
        .when(F.col("type") == "STILL IMAGE", F.col("source"))
        .when(F.col("year") % 2 == 0, F.concat_ws(" of ", "source", "type", "year")),
    )


def manual_items(spark: SparkSession, sf: str) -> DataFrame:
    """The manually cleaned subset: title, value, and position in its file."""
    chosen = labels(spark, sf).where("quality = 1").select("doc_id")
    return (
        items(spark, sf)
        .join(chosen, "doc_id")
        .select("doc_id", "title", F.upper("transcript").alias("transcript"))
    )


def messy(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "lang", "text")
    return profile.messy_columns(docs, "text")


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", F.col("text").alias("transcript"))
    return cleaning.clean_items(docs, date=None)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn and the assistant turn after it.

    Joined on conversation and turn, so a huge conversation is spread over all tasks.
    """
    turns = tables.load_table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    keys = ["conv_id", "turn"]
    return spread(asked, *keys).join(spread(told, *keys), keys)


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with three derived responses: half the answer, no punctuation, the question."""
    words = X.tokens(F.col("answer"))
    half = F.floor(F.size(words) / 2).cast("int")
    return questions(spark, sf).select(
        "conv_id",
        "turn",
        "question",
        "answer",
        F.concat_ws(" ", F.slice(words, F.lit(1), half)).alias("response_1"),
        F.regexp_replace("answer", "[.,]", "").alias("response_2"),
        F.col("question").alias("response_3"),
    )


def stub_model() -> generate.BatchFn:
    """A deterministic stand-in for a model: reversed prompt, error on an unreadable one."""

    def reply(batch: list[str]) -> list[str]:
        if any("ß" in p for p in batch):
            raise ValueError("unreadable")
        return [p[::-1] for p in batch]

    return reply


def half_down_model() -> generate.BatchFn:
    """The stand-in with every second prompt, by its length, lost."""

    def reply(batch: list[str]) -> list[str]:
        if any(len(p) % 2 for p in batch):
            raise ConnectionError("down")
        return stub_model()(batch)

    return reply


# -- sources and sinks --------------------------------------------------------------------


@query
def csv_round_trip(spark, sf):
    path = work_path(spark, "items-csv")
    docs = documents(spark, sf)
    csv.write_items_csv(docs, path)
    return csv.read_items_csv(spark, path, docs.schema)


@query
def csv_by_ranges(spark, sf):
    """Files of multi-line cells, cut into ranges and read by many tasks."""
    path = work_path(spark, "items-csv")
    docs = documents(spark, sf)
    csv.write_items_csv(docs, path)
    return csv.read_items_csv(spark, path, docs.schema, by_ranges=True)


@query
def csv_plain_round_trip(spark, sf):
    path = work_path(spark, "items-csv")
    docs = documents(spark, sf)
    csv.write_items_csv(docs, path, quote_all=False)
    return csv.read_items_csv(spark, path, docs.schema)


@query
def json_results(spark, sf):
    path = work_path(spark, "results-json")
    replies = generate.generate(
        documents(spark, sf).select("doc_id", "text"), "text", stub_model, batch_size=50
    )
    tables.write_json(replies.drop("sample", "text"), path)
    back = spark.read.schema("doc_id long, response string, error string").json(path)
    return back.na.fill("", ["response", "error"])


@query
def csv_other_order(spark, sf):
    """Columns are found by name, whatever their order in the file."""
    path = work_path(spark, "items-csv")
    docs = documents(spark, sf)
    csv.write_items_csv(docs.select("text", "n_chars", "source", "doc_id", "lang"), path)
    return csv.read_items_csv(spark, path, docs.schema)


@query
def required_columns(spark, sf):
    """Columns of the cleaned table that the raw one lacks."""
    wanted = ("doc_id", "transcript", "semi_clean_transcript", "lang", "year")
    missing = tables.require_columns(documents(spark, sf), wanted, on_missing="warn")
    kept = documents(spark, sf).agg(F.count(F.lit(1)).alias("row_count"))
    return kept.select(F.explode(F.lit(missing)).alias("column_name"), "row_count")


@query
def schema_difference(spark, sf):
    """Columns that labels add to the documents, with their types and filled cells."""
    joined = documents(spark, sf).join(labels(spark, sf), "doc_id")
    added = {r["column_name"]: r["column_type"] for r in tables.schema_diff(documents(spark, sf), joined).collect()}
    filled = joined.agg(*(F.count(c).alias(c) for c in added))
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("column_type"), F.col(c).alias("filled")) for c, t in added.items()]
    return filled.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query
def report_tables(spark, sf):
    folder = work_path(spark, "report")
    profile.write_report(messy(spark, sf).drop("text"), folder)
    return spark.read.parquet(f"{folder}/summary")


@query
def report_details(spark, sf):
    """The detail table of the report, as read back."""
    folder = work_path(spark, "report")
    tables.write_tables({"metadata": messy_rows(spark, sf)}, folder)
    return spark.read.parquet(f"{folder}/metadata")


@query
def bucket_files(spark, sf):
    """Items written by length bucket and read back from the folders."""
    path = work_path(spark, "buckets")
    fields.write_by_bucket(lengths(spark, sf).select("doc_id", "transcript"), "transcript", path)
    return spark.read.parquet(path).select("doc_id", "bucket")


@query
def listed_files(spark, sf):
    """Buckets whose files are found by a listing of the written folders."""
    path = work_path(spark, "buckets")
    fields.write_by_bucket(lengths(spark, sf).select("doc_id", "transcript"), "transcript", path)
    found = manifests.existing_files(spark, path, "*.parquet")
    return found.select(F.regexp_extract("path", "bucket=([^/]+)/", 1).alias("bucket")).distinct()


@query
def variant_tables(spark, sf):
    parts = tables.variant_tables(
        cleaned(spark, sf).select("doc_id", "original_transcript", "semi_clean_transcript"),
        {"original": "original_transcript", "semi_clean": "semi_clean_transcript"},
    )
    rows = [parts[k].withColumn("variant", F.lit(k)) for k in ("original", "semi_clean")]
    return rows[0].unionByName(rows[1])


def _manifests(spark, sf):
    """Manifests made from the page table: one to three canvases per page."""
    pages = tables.load_table(spark, sf, "pages").select("page_id", "url")
    n = (1 + F.length("url") % 3).cast("int")

    def canvas(i):
        service = F.struct(F.concat("url", F.lit("/"), i.cast("string")).alias("@id"))
        resource = F.struct(F.struct(service.alias("service")).alias("resource"))
        return F.struct(F.array(resource).alias("images"))

    canvases = F.transform(F.sequence(F.lit(1), n), canvas)
    body = F.struct(F.array(F.struct(canvases.alias("canvases"))).alias("sequences"))
    return pages.select(F.col("page_id").alias("item_id"), "url", F.to_json(body).alias("manifest"))


@query
def page_image_plan(spark, sf):
    return manifests.plan_page_images(_manifests(spark, sf), "documents/scans")


@query
def pending_pages(spark, sf):
    made = _manifests(spark, sf)
    plan = manifests.plan_page_images(made, "documents/scans")
    existing = manifests.plan_page_images(made.where(F.col("url").startswith("https")), "documents/scans")
    return manifests.pending_pages(plan, existing)


@query
def pending_by_ledger(spark, sf):
    """Pages that no run recorded: two runs that overlap, a compaction, and a third."""
    folder = work_path(spark, "ledger")
    made = _manifests(spark, sf)
    plan = manifests.plan_page_images(made, "documents/scans")
    done = manifests.plan_page_images(made.where(F.col("url").startswith("https")), "documents/scans")
    ledger.append(done.where("page < 3"), folder, "a")
    ledger.append(done.where("page = 1"), folder, "b")
    ledger.compact(spark, folder)
    ledger.append(done.where("page > 1"), folder, "c")
    return ledger.pending(plan, folder)


# -- fields -------------------------------------------------------------------------------


@query
def select_rename_drop(spark, sf):
    kept = documents(spark, sf).drop("n_chars", "no_such_column")
    return tables.rename_columns(kept, {"lang": "language", "source": "digital_collection"})


@query
def extract_year(spark, sf):
    orders = tables.load_table(spark, sf, "orders")
    date = F.date_format("o_orderdate", "MMMM d, yyyy")
    iso = F.col("o_orderdate").cast("date").cast("string")
    return orders.select(
        "o_orderkey",
        X.extract_year(iso).alias("year"),
        X.extract_year(date).alias("year_digits"),
        X.extract_year(date, "first4run").alias("year_run"),
    )


@query
def blank_and_length(spark, sf):
    text = F.concat(F.lit(" \t"), "text", F.lit("\n "))
    return documents(spark, sf).select(
        "doc_id",
        X.normalize_blank(text).alias("original_transcript"),
        X.char_len_nospace(F.col("text")).alias("original_len"),
    )


def _order_years(spark, sf):
    date = F.col("o_orderdate").cast("string")
    paid = F.when(F.col("o_orderstatus") != "P", date)
    return tables.load_table(spark, sf, "orders").withColumn("year", X.extract_year(paid))


@query
def filter_years(spark, sf):
    return fields.filter_years(_order_years(spark, sf), 1996, 1998).select("o_orderkey", "year")


@query
def year_or_zero(spark, sf):
    years = _order_years(spark, sf)
    return years.select("o_orderkey", X.year_or_zero(F.col("year")).alias("year"))


@query
def drop_null_keys(spark, sf):
    keyed = documents(spark, sf).withColumn(
        "item_number", F.when(F.col("lang") != "fr", F.col("doc_id").cast("double"))
    )
    return fields.drop_null_keys(keyed, "item_number").select("doc_id", "item_number")


@query
def length_buckets(spark, sf):
    return fields.with_bucket(lengths(spark, sf), "transcript").select("doc_id", "bucket")


@query
def split_by_bucket(spark, sf):
    return fields.bucket_counts(lengths(spark, sf), "transcript")


@query
def bucket_parts(spark, sf):
    """Buckets written once, each read from its own folder."""
    path = work_path(spark, "buckets")
    fields.write_by_bucket(lengths(spark, sf).select("doc_id", "transcript"), "transcript", path)
    parts = [df.select("doc_id", F.lit(b).alias("bucket")) for b, df in fields.bucket_tables(spark, path).items()]
    return reduce(DataFrame.unionByName, parts)


@query
def split_by_flag(spark, sf):
    clean_rows, messy_rows = fields.split_by_flag(messy(spark, sf), "any_messy")
    parts = [
        df.select("doc_id", F.lit(name).alias("part"))
        for name, df in (("clean", clean_rows), ("unclean", messy_rows))
    ]
    return parts[0].unionByName(parts[1])


@query
def trainable_rows(spark, sf):
    return fields.filter_trainable(items(spark, sf)).select("doc_id", "title", "transcript")


@query
def training_column(spark, sf):
    blanked = documents(spark, sf).withColumn(
        "training", F.when(F.col("lang") == "fr", F.lit(" \n")).otherwise(F.col("text"))
    )
    return fields.to_text(blanked, "training")


@query
def keep_and_combine(spark, sf):
    docs = documents(spark, sf)
    good = X.keep_where(F.col("text"), F.col("lang") == "en")
    other = X.keep_where(F.upper("text"), F.col("lang") == "de")
    return docs.select(
        "doc_id", good.alias("kept"), X.first_nonempty(good, other).alias("combined")
    )


@query
def apply_fixups(spark, sf):
    rules = [("^The ", "THE½ "), (r"\$\$", "S"), ("([aeiou])&", "$1 and ")]
    docs = documents(spark, sf).select("doc_id", "text")
    return fields.apply_fixups(docs, "text", rules)


@query
def row_numbers(spark, sf):
    docs = documents(spark, sf).select("doc_id", "lang")
    return row_identity.with_row_no(docs, ["lang", "doc_id"])


@query
def example_rows(spark, sf):
    rows = fields.example_rows(
        messy(spark, sf), "has_messy", "messy_sequences", "text", 10, "doc_id"
    )
    return rows.withColumn("sequences", F.array_join("sequences", LIST_MARK))


@query
def changed_rows(spark, sf):
    done = cleaned(spark, sf)
    changed = X.changed_flag(F.col("original_transcript"), F.col("semi_clean_transcript"))
    return done.select("doc_id", changed.alias("changed"))


# -- joins --------------------------------------------------------------------------------


def _null_keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("item_number", F.when(F.col("lang") != "fr", F.col("doc_id")))


@query
def restrict_to_subset(spark, sf):
    main = _null_keyed(documents(spark, sf))
    subset = main.join(labels(spark, sf), "doc_id").select("item_number")
    return joins.restrict_to(main, subset, "item_number").select("doc_id", "lang")


@query
def attach_column(spark, sf):
    main = items(spark, sf).select("doc_id", "title")
    right = manual_items(spark, sf).select("title", F.length("transcript").alias("clean_length"))
    return joins.attach(main, right, "title", ["clean_length"]).na.fill(-1, ["clean_length"])


@query
def override_values(spark, sf):
    return joins.override_values(
        items(spark, sf).select("doc_id", "title", "transcript"),
        manual_items(spark, sf),
        "title",
        "transcript",
        "doc_id",
    ).select("doc_id", "transcript", "overridden")


@query
def missing_keys(spark, sf):
    manual = manual_items(spark, sf)
    main = items(spark, sf).where("type = 'Text'")
    return joins.missing_keys(manual, main, "title")


@query
def file_row_numbers(spark, sf):
    """Numbers by file and place in it, of a table written in the order of its ids."""
    path = work_path(spark, "numbered")
    docs = documents(spark, sf).select("doc_id", "lang")
    docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return row_identity.with_file_row_no(spark.read.parquet(path))


@query
def updated_sample(spark, sf):
    return joins.updated_sample(
        items(spark, sf), manual_items(spark, sf), "title", "transcript", "doc_id"
    )


@query
def zip_rows(spark, sf):
    a = documents(spark, sf).select("doc_id", "lang")
    b = labels(spark, sf).select(F.col("doc_id").alias("label_id"))
    zipped = row_identity.zip_rows(
        row_identity.with_row_no(a, ["doc_id"], start=0),
        row_identity.with_row_no(b, ["label_id"], start=0),
    )
    return zipped.na.fill(-1, ["label_id"])


@query
def find_rows(spark, sf):
    numbered = row_identity.with_row_no(
        items(spark, sf).select("doc_id", "title"), ["doc_id"], start=0
    )
    return joins.find_rows(manual_items(spark, sf), numbered, "title")


@query
def unknown_tokens(spark, sf):
    words = spelling.row_tokens(documents(spark, sf), "doc_id", "text")
    return quality.unknown_tokens(words, dictionary(spark, sf))


# -- aggregates ---------------------------------------------------------------------------


@query
def type_counts(spark, sf):
    return profile.type_counts(items(spark, sf))


@query
def type_counts_by_bucket(spark, sf):
    return profile.type_counts(fields.with_bucket(lengths(spark, sf), "transcript"), by=["bucket"])


@query
def messy_summary(spark, sf):
    return profile.messy_summary(messy(spark, sf))


@query
def messy_summary_by_language(spark, sf):
    return profile.messy_summary(messy(spark, sf), by=["lang"])


@query
def top_general_sequences(spark, sf):
    return profile.top_sequences(messy(spark, sf), "messy_sequences")


@query
def top_special_sequences(spark, sf):
    return profile.top_sequences(messy(spark, sf), "special_messy_sequences")


@query
def top_repeat_sequences(spark, sf):
    return profile.top_sequences(messy(spark, sf), "repeat_sequences", 15)


@query
def flag_breakdown(spark, sf):
    return profile.flag_breakdown(messy(spark, sf))


@query
def flag_overlap(spark, sf):
    return profile.flag_overlap(messy(spark, sf))


@query
def summary_table(spark, sf):
    return profile.summary_table(messy(spark, sf))


@query
def empty_counts(spark, sf):
    done = cleaned(spark, sf).join(
        documents(spark, sf).select("doc_id", F.when(F.col("lang") != "fr", F.col("lang")).alias("language")),
        "doc_id",
    )
    return profile.empty_counts(
        done, ["original_transcript", "semi_clean_transcript", "language"]
    )


@query
def all_null_rows(spark, sf):
    french = F.col("lang") != "fr"
    gone = documents(spark, sf).select(
        F.when(french, F.col("doc_id")).alias("a"), F.when(french, F.col("text")).alias("b")
    )
    return fields.all_null_rows(gone).agg(F.count(F.lit(1)).alias("null_rows"))


def _compared(spark, sf, flagged=None):
    """Original against semi-clean transcripts, numbered as digests in the order of their ids."""
    docs = documents(spark, sf).select("doc_id", F.col("text").alias("transcript"))
    semi = cleaned(spark, sf)
    return compare.compare_column(
        docs,
        (semi.where(flagged) if flagged else semi).select("doc_id", "semi_clean_transcript"),
        "transcript",
        "semi_clean_transcript",
        order_by=["doc_id"],
    )


@query
def compare_summary(spark, sf):
    return _compared(spark, sf)["summary"].select(
        "rows_a", "rows_b", "rows_match", "exact_matches",
        F.round("exact_match_rate", 9).alias("exact_match_rate"), "total_differences",
        "nulls_a", "nulls_b", F.array_join("potential_issues", LIST_MARK).alias("potential_issues"),
    )


@query
def compare_differences(spark, sf):
    return _compared(spark, sf)["differences"]


@query
def compare_samples(spark, sf):
    return _compared(spark, sf)["samples"]


@query
def compare_unequal_tables(spark, sf):
    out = _compared(spark, sf, "general_pattern")["summary"]
    return out.select(
        "rows_a", "rows_b", "rows_match", "exact_matches_overlap",
        F.round("exact_match_rate_overlap", 9).alias("exact_match_rate_overlap"),
        F.array_join("potential_issues", LIST_MARK).alias("potential_issues"),
    )


@query
def quality_counts(spark, sf):
    return profile.quality_counts(quality.high_quality(documents(spark, sf), "text"))


@query
def duplicate_rows(spark, sf):
    return joins.duplicate_rows(items(spark, sf).select("doc_id", "title"), "title")


@query
def distinct_keys(spark, sf):
    return joins.count_distinct(items(spark, sf), "title")


@query
def vocabulary(spark, sf):
    return spelling.build_vocabulary(documents(spark, sf), ["text", "source"])


@query
def job_status(spark, sf):
    replies = generate.generate(
        documents(spark, sf).select("doc_id", "text"), "text", stub_model, batch_size=50
    )
    return generate.job_status(replies)


# -- text ---------------------------------------------------------------------------------


@query
def pattern_flags(spark, sf):
    return profile.pattern_flags(documents(spark, sf).select("doc_id", "text"), "text").drop("text")


@query
def profile_rows(spark, sf):
    return cleaned(spark, sf).select(
        "doc_id", "original_len", "special_pattern", "general_pattern", "repeat_chars",
        "short_transcript", "quality",
        F.array_join("issue_types", LIST_MARK).alias("issue_types"),
        F.array_join("detected_artifacts", LIST_MARK).alias("detected_artifacts"),
    )


@query
def messy_rows(spark, sf):
    lists = ("messy_sequences", "special_messy_sequences", "repeat_sequences")
    return (
        messy(spark, sf)
        .withColumns({c: F.array_join(c, LIST_MARK) for c in lists})
        .drop("text", "lang")
    )


@query
def remove_patterns_a(spark, sf):
    docs = documents(spark, sf)
    return docs.select("doc_id", X.remove_patterns(F.col("text"), "A").alias("text"))


@query
def remove_patterns_b(spark, sf):
    docs = documents(spark, sf)
    return docs.select("doc_id", X.remove_patterns(F.col("text"), "B").alias("text"))


@query
def squeeze_repeats(spark, sf):
    docs = documents(spark, sf)
    return docs.select("doc_id", X.collapse_repeats(F.col("text"), "squeeze").alias("text"))


@query
def stray_punctuation(spark, sf):
    docs = documents(spark, sf)
    bare = X.strip_stray_punct(F.replace(F.col("text"), F.lit("$"), F.lit("^")))
    return docs.select("doc_id", X.strip_unclosed_paren(bare).alias("text"))


@query
def space_runs(spark, sf):
    docs = documents(spark, sf)
    spaced = F.regexp_replace(F.replace(F.col("text"), F.lit(","), F.lit("     ")), "[.]", "  ")
    return docs.select("doc_id", X.normalize_spaces(spaced).alias("text"))


@query
def semi_clean(spark, sf):
    return cleaned(spark, sf).select("doc_id", "semi_clean_transcript")


@query
def semi_clean_messy(spark, sf):
    _, unclean = fields.split_by_flag(messy(spark, sf), "any_messy")
    return clean.semi_clean_messy(unclean, "text").select("doc_id", "semi_clean_transcript")


@query
def semi_clean_stream(spark, sf):
    schema = tables.load_table(spark, sf, "documents").schema
    done = clean_new_files(
        spark,
        f"{sf}/documents*.parquet",
        schema,
        work_path(spark, "stream-out"),
        work_path(spark, "stream-state"),
        date=None,
        text="text",
    )
    return done.select("doc_id", "semi_clean_transcript")


@query
def substitutions(spark, sf):
    docs = documents(spark, sf)
    marked = F.replace(F.replace(F.col("text"), F.lit("%"), F.lit("_")), F.lit("|"), F.lit("—"))
    return docs.select("doc_id", X.substitute_patterns(marked).alias("text"))


@query
def messy_scores(spark, sf):
    docs = documents(spark, sf).select("doc_id", X.messy_score(F.col("text")).alias("messy_score"))
    return docs.withColumn("is_messy", X.is_messy(F.col("messy_score"), 0.02))


@query
def condensed_text(spark, sf):
    return documents(spark, sf).select("doc_id", X.condense_ws(F.col("text")).alias("text"))


@query
def quality_gate(spark, sf):
    gated = quality.high_quality(documents(spark, sf), "text")
    return gated.select("doc_id", "quality_transcript", F.coalesce("fail_reason", F.lit("")).alias("fail_reason"))


@query
def quality_gate_with_dictionary(spark, sf):
    gated = quality.high_quality(documents(spark, sf), "text", dictionary(spark, sf), "doc_id")
    return gated.select("doc_id", "quality_transcript", F.coalesce("fail_reason", F.lit("")).alias("fail_reason"))


@query
def spelling_suggestions(spark, sf):
    words = dictionary(spark, sf)
    tokens = spelling.row_tokens(documents(spark, sf), "doc_id", "text").select("word").distinct()
    unknown = quality.unknown_tokens(tokens, words).withColumnRenamed("word", "token")
    return spelling.suggest(unknown, words)


@query
def corrected_text(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    fixed = spelling.correct_spelling(docs, "doc_id", "text", dictionary(spark, sf))
    return fixed.select("doc_id", "corrected_transcript")


@query
def correction_metrics(spark, sf):
    text = F.col("original_transcript")
    marked = F.when(text.contains("$"), F.regexp_replace(text, r"\$+", "[$0]")).otherwise(text)
    done = cleaned(spark, sf).withColumn("flagged", marked)
    return evaluate.correction_metrics(
        done,
        ["original_transcript", "original_transcript"],
        ["semi_clean_transcript", "flagged"],
        keys=["doc_id"],
    ).withColumn("percent_changed", F.round("percent_changed", 6))


@query
def list_literals(spark, sf):
    printed = cleaned(spark, sf).select(
        "doc_id", parsing.format_list_literal(F.col("detected_artifacts")).alias("printed")
    )
    return printed.select(
        "doc_id", F.array_join(parsing.parse_list_literal(F.col("printed")), LIST_MARK).alias("artifacts")
    )


@query
def word_chunks(spark, sf):
    return tasks.chunk_words(documents(spark, sf).select("doc_id", "text"), "text")


@query
def rejoined_chunks(spark, sf):
    chunks = tasks.chunk_words(documents(spark, sf).select("doc_id", "text"), "text", n=50)
    return tasks.join_chunks(chunks, "doc_id")


@query
def sentence_split(spark, sf):
    parts = X.split_at_ratio(F.col("text"), 0.5)
    return documents(spark, sf).select("doc_id", parts.alias("p")).select("doc_id", "p.first", "p.second")


@query
def split_ratios(spark, sf):
    ratios = documents(spark, sf).select("doc_id", draws.split_ratios(F.col("doc_id")).alias("r"))
    names = ("beginning", "middle_gap", "end_start", "mid_split")
    return ratios.select("doc_id", *[F.round(f"r.{n}", 9).alias(n) for n in names])


@query
def parsed_ocr_results(spark, sf):
    docs = documents(spark, sf)
    reply = F.to_json(
        F.struct("source", F.col("text").alias("ocr_transcript"), F.col("lang").alias("notes"), F.upper("text").alias("fixed_transcript"))
    )
    broken = F.when(F.col("lang") == "es", F.concat(F.lit("no JSON: "), "text")).otherwise(reply)
    parsed = docs.select("doc_id", parsing.parse_ocr_json(broken).alias("p")).select("doc_id", "p.*")
    return parsed.na.fill("")


@query
def parsed_spell_outputs(spark, sf):
    docs = documents(spark, sf)
    good = F.to_json(
        F.struct(F.col("text").alias("spell_corrected_text"), F.create_map("lang", "source").alias("correction_dict"))
    )
    cell = F.when(F.col("lang") == "de", F.lit("oops")).otherwise(good)
    parsed = docs.select("doc_id", parsing.parse_spell_output(cell).alias("p"))
    return parsed.select(
        "doc_id",
        "p.spell_corrected_text",
        F.array_join(F.map_keys("p.correction_dict"), LIST_MARK).alias("corrected_words"),
        F.array_join(F.map_values("p.correction_dict"), LIST_MARK).alias("corrections"),
    )


# -- datasets and generation --------------------------------------------------------------


@query
def completion_tasks(spark, sf):
    return tasks.completion_tasks(items(spark, sf), key="doc_id")


@query
def skipped_documents(spark, sf):
    return tasks.skipped_documents(items(spark, sf), key="doc_id")


@query
def title_training_text(spark, sf):
    rows = fields.filter_trainable(items(spark, sf))
    return tasks.training_text(rows, "title").select("doc_id", "text")


@query
def task_training_text(spark, sf):
    rows = datasets.instruction_rows(items(spark, sf), key="doc_id")
    return rows.select("original_index", "task_type", "text")


@query
def qa_prompts(spark, sf):
    asked = questions(spark, sf)
    out = asked.select("conv_id", "turn", "question")
    for name in ("qa", "examples", "chat"):
        out = prompts.build_prompts(out, "question", name, out=f"{name}_prompt")
    return out.drop("question")


@query
def correction_prompts(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    out = prompts.build_prompts(docs, "text", "restore", out="restore_prompt")
    return prompts.build_prompts(out, "text", "proofread", out="proofread_prompt").drop("text")


@query
def chat_messages(spark, sf):
    asked = prompts.build_prompts(questions(spark, sf), "question", "messages", out="messages")
    return asked.select("conv_id", "turn", F.posexplode("messages").alias("position", "m")).select(
        "conv_id", "turn", "position", "m.role", "m.content"
    )


@query
def generated_replies(spark, sf):
    asked = prompts.build_prompts(questions(spark, sf), "question", "qa").select("conv_id", "turn", "prompt")
    replies = generate.generate(asked, "prompt", stub_model, num_samples=3)
    return replies.drop("prompt").na.fill("", ["response", "error"])


@query
def resumed_replies(spark, sf):
    """The replies of a job that failed for half its prompts and was run again."""
    folder = work_path(spark, "replies")
    asked = prompts.build_prompts(questions(spark, sf), "question", "qa").select("conv_id", "turn", "prompt")
    resumable.ask_missing(asked, "prompt", half_down_model, folder, num_samples=3)
    resumable.ask_missing(asked, "prompt", stub_model, folder, num_samples=3, batches=2)
    replies = resumable.with_replies(asked, "prompt", folder, num_samples=3)
    return replies.drop("prompt").na.fill("", ["response", "error"])


@query
def wide_responses(spark, sf):
    asked = questions(spark, sf).select("conv_id", "turn", "question", "answer")
    replies = generate.generate(asked, "question", stub_model, num_samples=2)
    wide = generate.widen_responses(replies, ["conv_id", "turn", "question", "answer"], 2)
    return wide.na.fill("", ["response_1", "response_2"])


@query
def cleaned_replies(spark, sf):
    q, a = F.col("question"), F.col("answer")
    raw = F.concat(q, F.lit(" \n"), a, F.lit(" "))
    marked = F.concat(q, F.lit(parsing.ASSISTANT_MARK + "\n"), a)
    quoted = F.concat(F.lit(' "'), a, F.lit('" '))
    tuned = F.concat(q, F.lit("\n" + parsing.RESPONSE_MARK + " "), a)
    return questions(spark, sf).select(
        "conv_id",
        "turn",
        parsing.clean_reply(raw, "prefix", q).alias("after_prompt"),
        parsing.clean_reply(marked, "assistant").alias("after_assistant"),
        parsing.clean_reply(quoted, "quotes").alias("unquoted"),
        parsing.clean_reply(tuned, "response").alias("after_response"),
        parsing.clean_reply(a, "response").alias("no_marker"),
    )


@query
def corrected_columns(spark, sf):
    docs = documents(spark, sf).select(
        "doc_id", "text", F.when(F.col("lang") != "fr", F.col("source")).alias("source")
    )
    out = generate.correct_columns(docs, ["text", "source"], stub_model)
    return out.select("doc_id", "text_cleaned", F.coalesce("source_cleaned", F.lit("")).alias("source_cleaned"))


def stub_tokenizer():
    """A deterministic stand-in for a tokenizer: the length of every blank-separated word."""
    return lambda texts: [[len(w) for w in t.split(" ")] for t in texts]


@query
def token_rows(spark, sf):
    rows = generate.token_ids(documents(spark, sf).select("doc_id", "text"), "text", stub_tokenizer)
    return rows.select("doc_id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


@query
def packed_tokens(spark, sf):
    ids = F.transform(X.tokens(F.col("text")), lambda w: F.length(w) * 1000 + F.ascii(w) % 1000)
    packed = generate.pack_tokens(
        documents(spark, sf).select("doc_id", ids.alias("tokens")), "tokens", 256, pad_id=7
    )
    names = ("input_ids", "attention_mask", "labels")
    return packed.select(
        "doc_id", *[F.array_join(F.transform(n, lambda x: x.cast("string")), " ").alias(n) for n in names]
    )


@query
def partly_applied(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.when(F.col("lang") != "fr", F.col("text")).alias("text"))
    out = generate.partial_apply(
        docs, F.col("text").isNotNull(), lambda d: d.withColumn("text_cleaned", X.condense_ws(F.col("text")))
    )
    return out.na.fill("", ["text", "text_cleaned"])


@query
def selected_years(spark, sf):
    _, chosen = datasets.select_years(items(spark, sf), cols=("doc_id", "transcript"))
    return chosen


@query
def merged_variants(spark, sf):
    done = cleaned(spark, sf).select("doc_id", "original_transcript", "semi_clean_transcript")
    manual = manual_items(spark, sf).select("doc_id", F.col("transcript").alias("clean_transcript"))
    cols = ["doc_id", "original_transcript", "semi_clean_transcript"]
    return datasets.merge_variants(done, manual, "doc_id", cols)


# -- evaluation ---------------------------------------------------------------------------

IDS = ["conv_id", "turn", "question", "answer"]


def _scored(df: DataFrame, ref: str, ids: list[str]) -> DataFrame:
    rows = evaluate.score_rows(df, ids, ref)
    checked = ("bleu", "jsd", "jaccard", "levenshtein")
    return rows.select("conv_id", "turn", "model", *[F.round(m, 6).alias(m) for m in checked])


@query
def unpivoted_models(spark, sf):
    return evaluate.unpivot_models(answered(spark, sf), IDS).select("conv_id", "turn", "model", "response")


@query
def answered_questions(spark, sf):
    """The whole answering plan over all questions and a copy of each: no row is lost."""
    asked = questions(spark, sf)
    twice = asked.union(asked).select("question", "answer")
    return datasets.answer_questions(twice, stub_model, num_samples=2).na.fill("", ["response_1", "response_2"])


@query
def accuracy_scores(spark, sf):
    return _scored(answered(spark, sf), "answer", IDS)


@query
def consistency_scores(spark, sf):
    return _scored(answered(spark, sf), "response_1", [*IDS, "response_1"])


@query
def rouge_l_scores(spark, sf):
    rows = evaluate.score_rows(answered(spark, sf), IDS, "answer")
    return rows.select("conv_id", "turn", "model", F.round("rouge_l", 6).alias("rouge_l"))


@query
def mean_scores(spark, sf):
    rows = evaluate.score_rows(answered(spark, sf), IDS, "answer")
    means = evaluate.mean_scores(rows)
    return means.withColumn("score", F.round("score", 6))


@query
def mean_scores_wide(spark, sf):
    rows = evaluate.score_rows(answered(spark, sf), IDS, "answer")
    return rows.groupBy("model").agg(
        *[F.round(F.avg(m), 6).alias(m) for m in evaluate.METRICS]
    )
