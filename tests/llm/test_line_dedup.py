from vectorvote.llm.line_dedup import dedup_lines


def test_windows(spark):
    abc = "a a\nb b\n\nc c"
    rows = [
        (1, abc + "\nd"),
        (2, "x\n" + abc + "\ny"),  # the whole window goes
        (3, "a a\nb b\nz"),  # two shared lines are no window
        (4, None),
        (5, ""),
        (6, "q\nr\ns\nr\nq\nr\ns"),  # a repeat in one text
        (7, "dup\ndup2\ndup3"),
        (7, "dup\ndup2\ndup3"),  # a repeated row removes nothing
        (8, "e\nb b\nc c\nd\nf"),  # overlaps the end of document 1: b b, c c, d
        (None, "n1\nn2\nn3"),
    ]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, source string, n_lines int")
    out = dedup_lines(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = dict(rows) | {2: "x\n\ny", 6: "q\nr\ns\nr", 8: "e\nf"}
    assert got == sorted(((i, want[i]) for i, _ in rows), key=str)
    assert dedup_lines(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    lines = [f"line {k} of the long text" for k in range(100_000)]
    rows = [(1, "\n".join(lines + ["between"] + lines[:3])), (2, "\n".join(["new"] + lines[50_000:50_003])), (3, "\n".join(lines[99_990:])), (4, "w " * 1_000_000)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), report=True).collect()}
    assert {k: r.text for k, r in got.items()} == {1: "\n".join(lines + ["between"]), 2: "new", 3: "", 4: "w " * 1_000_000}
    assert {k: (r.n_lines, r.n_removed) for k, r in got.items()} == {1: (100_004, 3), 2: (4, 3), 3: (10, 10), 4: (1, 0)}
