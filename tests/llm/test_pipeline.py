"""The pipeline against a brute-force version of its stages, and the oracle SQL of the operators that have one."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


#: Encoded data: letters, but in no language.
NOISE = "".join(np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyz0123456789+/"), 700))


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())


def brute(docs, items):
    """doc_id -> text after the first four stages."""
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t) and t != NOISE]
    # later occurrences of three consecutive lines
    seen, out = {}, []
    for i, t in sorted(docs):
        lines = t.split("\n")
        ink = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for a in range(len(ink) - 2):
            key = tuple(lines[ink[a + j]] for j in range(3))
            if key in seen and seen[key] != (i, t, a):
                gone |= {ink[a + j] for j in range(3)}
            seen.setdefault(key, (i, t, a))
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    # near-duplicates
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets, comp = [shingles(t) for _, t in out], list(range(len(out)))
    for _ in out:
        before = list(comp)
        for x in range(len(out)):
            for y in range(x):
                both = len(sets[x] & sets[y])
                if both and 100 * both >= 80 * len(sets[x] | sets[y]):
                    comp[x] = comp[y] = min(comp[x], comp[y])
        if comp == before:
            break
    out = [d for k, d in enumerate(out) if comp[k] == k]
    # benchmark passages
    grams = {tuple(w[a : a + 10]) for w in map(tokens, items) for a in range(max(len(w) - 9, 1)) if w}
    left = {}
    for i, t in out:
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())]
        w = tokens(t)
        hit = {a + j for g in grams for a in range(len(w) - len(g) + 1) if tuple(w[a : a + len(g)]) == g for j in range(len(g))}
        if w and len(hit) == len(w):
            continue
        text, at, k = "", 0, 0
        while k < len(w):
            if k in hit:
                end = k
                while end + 1 in hit:
                    end += 1
                text += t[at : spans[k][0]]
                at, k = spans[end][1], end
            k += 1
        left[i] = text + t[at:]
    return left


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = np.random.default_rng(8)
    vocab = {"en": "the of and to in that with house water garden light".split(), "de": "der die und das nicht haus wasser garten licht über".split(), "fr": "le la et les des maison eau jardin lumière été".split()}
    line = lambda lang: " ".join(r.choice(vocab[lang], 8)).capitalize() + "."
    rows = []
    for k in range(90):
        lang = ["en", "de", "fr"][k % 3]
        rows.append((k, "\n".join(line(lang) for _ in range(int(r.integers(1, 9)))), lang))
    shared = "\n".join(line("en") for _ in range(4))
    bench = " ".join(r.choice(vocab["en"], 14))
    rows += [(k, rows[k - 100][1] + "\n" + shared, "en") for k in (100, 103, 106)]
    rows += [(200, rows[0][1], "en"), (201, f"Before {bench} after it all.", "en"), (202, bench, "en"), (203, None, "en"), (204, "123 456", "en"), (205, "", None), (206, NOISE, None), (207, f"{line('en')} {line('fr')} {line('en')}", None)]
    path = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame([(i, t, g, "src", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, [bench]


def test_pipeline(spark, folder):
    import hashlib

    path, rows, items = folder
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in brute([(i, t) for i, t, _ in rows], items).items()}
    assert {x.doc_id: x.decoded_sha256 for x in corpus_pipeline.run(spark, path).collect()} == want
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.where("n_chars <> length(text)").count() == 0


CLASHES = ("node", "root", "h", "th", "id", "first", "score", "lang_pred", "at", "pos", "n_lines", "spans", "items", "sig", "a", "b")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_with_clashing_columns_and_empty(spark, folder, name, stage):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id >= 80")
    docs = docs.union(docs.where("doc_id in (80, 203, 205)"))  # repeated rows
    more = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    plain, wide = stage(spark, docs, path), stage(spark, more, path)
    columns = plain.columns if name == "tokens" else docs.columns
    assert wide.columns == (columns if name == "tokens" else more.columns)
    assert sorted(map(str, wide.select(*columns).collect())) == sorted(map(str, plain.collect()))
    assert stage(spark, docs.limit(0), path).count() == 0


ORACLES = ["op3_decontaminate", "op4_near_dedup", "op7_line_dedup"]


@pytest.mark.parametrize("name", ORACLES)
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_oracle(spark, name):
    import duckdb

    import __spark_entry__ as entry

    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rows = entry.queries()[name](spark, data)
    columns = sorted(rows.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, rows.select(*columns).collect()))) == sorted(map(str, want))
