"""Line dedup against a plain scan in the order of documents."""

import random

import corpus_pipeline as P
from palimpsest.llm import line_dedup as L
from palimpsest.llm import queries as Q


def plain(rows):
    """Texts of distinct ids without later repeats of three lines, of a long line, or of one with its neighbour."""
    seen, out = set(), {}
    for ident, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
        gone = set()
        for length in (1, 2, 3):
            for s in range(len(full) - length + 1):
                run = tuple(lines[i] for i in full[s : s + length])
                if length < 3 and not any(len(x) >= 40 or len(x.encode().split()) >= 5 for x in run):
                    continue
                if run in seen:
                    gone.update(range(full[s], full[s + length - 1] + 1))
                seen.add(run)
        out[ident] = text if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def got(df):
    return {r.doc_id: r.text for r in L.remove_repeated_runs(df).collect()}


def test_matches_plain_scan(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == plain(rows)


def test_random_lines(frame):
    draw = random.Random(3)
    lines = ["a", "b", "c", "", " ", "five words make it long", "x" * 40, "é" * 39, "four words are short"]
    rows = [(i, "\n".join(draw.choice(lines[: draw.choice([5, 9])]) for _ in range(draw.randrange(30)))) for i in range(120)]
    assert got(frame(rows)) == plain(rows)


def test_odd_rows(odd, none):
    done = L.remove_repeated_runs(odd)
    assert set(done.columns) == {*odd.columns, "n_lines"}
    assert done.count() == odd.count() and L.remove_repeated_runs(none).count() == 0
    assert sorted(map(repr, (r.text for r in done.collect()))) == sorted(map(repr, (r.text for r in odd.collect())))


def test_passage_in_a_third_of_all_documents(frame):
    passage = "one line\nand another\nand a third\nand the last"
    rows = [(i, f"own {i}\n{passage}\nend {i}" if i % 3 == 0 else f"text {i}") for i in range(600)]
    texts = got(frame(rows))
    assert texts == plain(rows) and texts[0].count("another") == 1 and texts[3] == "own 3\nend 3"


def test_one_long_line_between_other_neighbours(frame, spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(i, f"before {i}\n{long}\n\nafter {i}\nlast {i}\nYes.\nNo.\nend {i}") for i in range(20)]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in Q.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert texts[0] == rows[0][1] and texts == plain(rows)
    # The long line goes, the short pair stays.
    assert all(texts[i] == f"before {i}\n\nafter {i}\nlast {i}\nYes.\nNo.\nend {i}" for i in range(1, 20))
    staged = P.lines(spark, frame(rows), str(tmp_path)).collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in staged} == {i: (t, len(t)) for i, t in texts.items()}


def test_matches_grow_to_their_neighbours(frame):
    rows = [(1, "x\nshort\na line of five words or more\nend\ny"), (2, "z\nshort\na line of five words or more\nend\nw"),
            (3, "short\na line of five words or more\nother")]
    assert got(frame(rows)) == {1: rows[0][1], 2: "z\nw", 3: "other"}


def test_selection_is_sparse_and_shared():
    lines = [f"l{i % 90}" for i in range(300)]
    marks = [m for m, _ in L._marks_of("\n".join(lines), 2, 2)]
    assert len(marks) < 0.85 * len(lines)
    one, two = ({m for m, _ in L._marks_of("\n".join(x), 2, 2)} for x in (lines[:40], ["o", *lines[10:13], "p"]))
    assert one & two
