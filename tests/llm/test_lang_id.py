import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorvote.llm import lang_id

WORDS = {
    "en": "the of and to in that with house water garden light was not they".split(),
    "de": "der die und das nicht haus wasser garten licht über wurde sie ein".split(),
    "fr": "le la et les des maison eau jardin lumière été dans une pour".split(),
    "es": "el la y los de casa agua jardín luz está una para niño".split(),
}


def frame(spark, n=400):
    r = np.random.default_rng(6)
    rows = []
    for k in range(n):
        lang = ["en", "de", "fr", "es"][k % 4]
        rows.append((k, " ".join(r.choice(WORDS[lang], int(r.integers(3, 40)))), lang, "s", k))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "12 34 !!", "de", "s", 0), (1003, "le jardin et la maison dans une lumière", None, "s", 0), (1004, "x " * 50 + "the water of the garden " * 20_000, "en", "s", 0), (7, rows[7][1], rows[7][2], "s", 0), (None, "der garten und das haus", "de", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")


def test_held_out_accuracy_and_cases(spark):
    df = frame(spark)
    got = lang_id.predict(df, lang_id.fit(df), ["lang"]).withColumn("held", lang_id.held_out()).collect()
    assert len(got) == df.count()
    held = [x for x in got if x.held and x.lang and x.lang_pred != "und"]
    assert len(held) > 60 and np.mean([x.lang == x.lang_pred for x in held]) >= 0.97
    by = {x.doc_id: x for x in got}
    for k in (1000, 1001, 1002):
        assert (by[k].lang_pred, by[k].score) == ("und", 0)
    assert by[1003].lang_pred == "fr" and by[1004].lang_pred == "en" and by[None].lang_pred == "de"
    assert all(0 <= x.score <= 1 for x in got)


def test_machines_reach_the_solution():
    """The weights are a minimum: their gradient, written out here in plain sums, is small against that of none."""
    r = np.random.default_rng(2)
    y = np.where(r.random(60) < 0.3, 1.0, -1.0).astype(np.float32)
    x = np.hstack([r.normal(size=(60, 5)) + 0.8 * y[:, None], np.ones((60, 1))]).astype(np.float32)

    def gradient(w):
        g = w.copy()
        for a, b in zip(x.astype(float), y):
            g -= 2 * 40 * 0.5 / (y == b).sum() * b * max(0.0, 1 - b * (a @ w)) * a
        return np.abs(g).max()

    w = lang_id._svm(x, y[:, None], rounds=2000)[:, 0].astype(float)
    assert gradient(w) < 1e-3 * gradient(np.zeros(6))
    assert np.allclose(lang_id._svm(np.vstack([x, x]), np.concatenate([y, 0 * y])[:, None], rounds=2000)[:, 0], w, atol=1e-3)


DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_stage_rejects_what_is_no_learned_language(spark):
    r = random.Random(3)
    noise = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(600))
    df = spark.read.parquet(DATA)
    more = [(-1, noise, None, "s", 1), (-2, "zażółć gęślą jaźń które jest bardzo dobrze w polsce nie wiem czy to", None, "s", 1), (-3, None, "en", "s", 0), (-4, "12 34", "en", "s", 0)]
    both = df.union(spark.createDataFrame(more, df.schema))
    kept = {x.doc_id for x in lang_id.keep_identified(both).collect()}
    assert kept == {x.doc_id for x in df.collect() if lang_id._has_letter(x.text)}


def test_stage_without_labels_keeps_nothing(spark):
    none = frame(spark, 40).withColumn("lang", F.lit(None).cast("string"))
    assert lang_id.keep_identified(none).count() == 0


def test_sample_is_bounded_and_of_the_smallest_hashes(spark):
    df = frame(spark)
    got = lang_id.training_sample(df, 10).groupBy("lang").count().collect()
    assert {x["lang"]: x["count"] for x in got} == {"en": 10, "de": 10, "fr": 10, "es": 10}
    every = df.where("lang = 'fr' and text is not null").where(~lang_id.held_out()).orderBy(F.xxhash64("doc_id", F.lit(9))).limit(10)
    assert sorted(x.text for x in every.collect()) == sorted(x.text for x in lang_id.training_sample(df, 10).where("lang = 'fr'").collect())


def test_lang_is_no_input_of_a_prediction(spark):
    df = frame(spark, 200)
    model = lang_id.fit(df)
    one = lang_id.predict(df, model).orderBy("doc_id", "score").collect()
    other = lang_id.predict(df.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)).repartition(3), model).orderBy("doc_id", "score").collect()
    assert one == other


def test_no_labels_one_label_and_empty(spark):
    df = frame(spark, 40)
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {x.lang_pred for x in lang_id.predict(none, lang_id.fit(none)).collect()} == {"und"}
    one = df.where("lang = 'fr'")
    assert {x.lang_pred for x in lang_id.predict(one, lang_id.fit(one)).collect()} == {"fr"}
    assert lang_id.predict(df.limit(0), lang_id.fit(df)).count() == 0
    kept = lang_id.keep_identified(df.withColumn("lang_pred", F.lit(1))).drop("lang_pred")
    assert kept.columns == df.columns and kept.count() == df.count() - 3
