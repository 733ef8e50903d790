"""Language identification by hierarchical discrimination.

A linear support vector machine picks the language family first; one-versus-one machines then separate
the languages of that family.  Features are hashed byte trigrams of the whole text, scaled by fixed
per-feature weights, so every machine is a sum over text positions and whole documents of any length
are scored in bounded memory.

Fitting uses a bounded sample, a documented parameter: of each language the `train_per_lang` (default 400) labelled documents of the
smallest hashes of doc_id, and at most TRAIN_ROWS in all.  One task fits; the driver gets the machines' weights.

Defined results: null text, or text without a letter -> `und`, score 0.  Null `lang` is never learned
from.  Without any labelled document every prediction is `und` with score 0; with one language all documents
with letters get it.  Repeated rows get equal predictions; an empty table gives an empty result; extra columns
are ignored.  Ties go to the alphabetically first name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .text import LOWER, U64, as_table, flat, slices

FEATURES = 2048
MODULUS, HELD = 4, 2
#: Bounds of the sample: documents of each language, and of all.
TRAIN_PER_LANG, TRAIN_ROWS = 400, 12_000
#: How far below the training texts' own a text's mean log2 frequency of its features may lie: SLACK, and SPREAD / sqrt(features).
SLACK, SPREAD = 1.2, 6.0
#: Families of ISO 639-1 codes.  A code that is not listed forms a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "pa", "gu", "ne"),
    "sinitic": ("zh", "yue"),
}


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), lang)


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature of each trigram position, and the positions of each document (trigrams do not cross documents)."""
    low = LOWER[buf]
    low = np.where((low >= 97) & (low <= 122) | (low >= 128), low, np.uint8(32)).astype(np.uint32)
    n = len(low)
    padded = np.concatenate([low, np.full(2, 32, np.uint32)])
    code = (padded[:n] << np.uint32(16)) | (padded[1 : n + 1] << np.uint32(8)) | padded[2 : n + 2]
    for back in (1, 2):  # the last two positions of a document see blanks, not the next document
        at = offs[1:] - back
        at = at[(at >= offs[:-1])]
        if len(at):
            code[at] = (code[at] >> np.uint32(8 * (3 - back)) << np.uint32(8 * (3 - back))) | np.uint32(0x2020 if back == 1 else 0x20)
    feature = ((code.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - 11)).astype(np.int64)
    feature[code == 0x202020] = -1
    return feature, offs


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def features(text: bytes) -> np.ndarray:
    """Relative frequencies of the hashed trigrams of one text."""
    buf = np.frombuffer(text, np.uint8)
    feature, _ = _grams(buf, np.array([0, len(buf)]))
    feature = feature[feature >= 0]
    return (np.bincount(feature, minlength=FEATURES) / max(1, len(feature))).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 40.0, rounds: int = 80) -> np.ndarray:
    """Linear SVMs with squared hinge loss, classes weighted alike: a column of weights for each column of y, by accelerated
    gradient descent on the primal.  y is 1, -1, or 0 for rows that a machine doesn't see."""
    share = lambda side: 0.5 / np.maximum(1, side.sum(0))
    weight = ((y > 0) * share(y > 0) + (y < 0) * share(y < 0)).astype(np.float32)
    v = np.ones((x.shape[1], y.shape[1]), np.float32)
    for _ in range(15):
        v = x.T @ (weight * (x @ v))
        top = np.linalg.norm(v, axis=0)
        v /= top + 1e-12
    step = (1 / (1 + 2 * cost * top * 1.05)).astype(np.float32)
    w = z = np.zeros_like(v)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (z - np.float32(2 * cost) * (x.T @ (weight * y * slack)))
        z = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


class Model:
    """Machines over FEATURES: columns of `weights`, with `bias`.  First the families one-versus-rest, then pairs of languages."""

    def __init__(self, langs: list[str], weights: np.ndarray | None = None):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(x) for x in self.langs})
        self.members = [[x for x in self.langs if family_of(x) == f] for f in self.families]
        #: family, its two languages, and the column of their machine
        self.pairs: list[tuple[int, str, str, int]] = []
        many = len(self.families) > 1
        column = len(self.families) if many else 0
        for k, own in enumerate(self.members):
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    self.pairs.append((k, a, b, column))
                    column += 1
        # the last column is no machine: log2 of the features' frequencies in the languages on average, less that of the training texts
        self.weights, self.bias = (np.zeros((FEATURES, column + 1), np.float32), np.zeros(column + 1)) if weights is None else (weights[:-1], weights[-1].astype(np.float64))

    @classmethod
    def fitted(cls, vectors: np.ndarray, labels: np.ndarray) -> Model:
        model = cls(list(labels))
        scale = (1 / np.sqrt(vectors.mean(0, dtype=np.float64) + 1e-4)).astype(np.float32)
        x = np.empty((len(vectors), FEATURES + 1), np.float32)
        np.multiply(vectors, scale, out=x[:, :-1])
        x[:, -1] = 1
        weights = np.empty((FEATURES + 1, model.weights.shape[1]), np.float32)
        family = np.array([model.families.index(family_of(v)) for v in labels], dtype=int)
        if len(model.families) > 1:
            weights[:, : len(model.families)] = _svm(x, np.where(family[:, None] == np.arange(len(model.families)), 1, -1).astype(np.float32))
        for k in range(len(model.families)):
            own = [p for p in model.pairs if p[0] == k]
            if own:
                rows = family == k
                y = np.stack([(labels[rows] == a).astype(np.float32) - (labels[rows] == b) for _, a, b, _ in own], 1)
                weights[:, own[0][3] : own[-1][3] + 1] = _svm(x[rows], y)
        weights[:-1] *= scale[:, None]
        means = np.stack([vectors[labels == v].mean(0, dtype=np.float64) for v in model.langs])
        weights[:-1, -1] = np.log2(means.mean(0) + 0.04 / FEATURES)
        weights[-1, -1] = -(means @ weights[:-1, -1]).mean()
        return cls(list(labels), weights)

    def margins(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Margin of every machine for every document of a slice."""
        feature, _ = _grams(buf, offs)
        n = len(offs) - 1
        table = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]), np.float32)])
        counts = np.concatenate([[0], np.cumsum(feature >= 0)])
        total = np.maximum(counts[offs[1:]] - counts[offs[:-1]], 1)
        out = np.empty((n, len(self.bias)))
        full = np.flatnonzero(np.diff(offs) > 0)
        for m, b in enumerate(self.bias):
            sums = np.zeros(n)
            if len(full):  # each document is added up by itself, so its neighbours don't change its rounding
                sums[full] = np.add.reduceat(table[:, m].astype(np.float64)[feature], offs[:-1][full])
            out[:, m] = sums / total + b
        return out

    def familiar(self, margins: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Whether each text may be in a learned language, pure or mixed, by how frequent its features are in those."""
        return margins[:, -1] >= -SLACK - SPREAD / np.sqrt(np.maximum(np.diff(offs), 1))

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Family by the largest margin; in it the language with most one-versus-one wins; score is the product of sigmoids of the margins used."""
        n, many = len(margins), len(self.families) > 1
        squash = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
        chosen = margins[:, : len(self.families)].argmax(1) if many else np.zeros(n, int)
        score = squash(margins[np.arange(n), chosen]) if many else np.ones(n)
        name = np.empty(n, dtype=object)
        for k, own in enumerate(self.members):
            rows = np.flatnonzero(chosen == k)
            votes = np.zeros((len(rows), len(own)))
            worst = np.full((len(rows), len(own)), np.inf)
            for f, a, b, col in self.pairs:
                if f == k and len(rows):
                    m, i, j = margins[rows, col], own.index(a), own.index(b)
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    worst[:, i] = np.minimum(worst[:, i], m)
                    worst[:, j] = np.minimum(worst[:, j], -m)
            best = votes.argmax(1) if len(rows) else np.zeros(0, int)
            name[rows] = [own[i] for i in best]
            if len(own) > 1 and len(rows):
                score[rows] *= squash(worst[np.arange(len(rows)), best])
        return list(name), score


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % MODULUS == HELD, F.lit(False))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each text, and of short pieces of it, which teach the machines short documents."""
    schema = pa.schema([("lang", pa.string()), ("x", pa.binary())])
    for batch in batches:
        langs, xs = [], []
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            raw = text.as_py().encode()
            for cut in (len(raw), 400, 60):
                if (cut == len(raw) or cut < len(raw)) and _has_letter(raw[:cut].decode(errors="ignore")):
                    langs.append(lang.as_py())
                    xs.append(features(raw[:cut]).tobytes())
        yield as_table(schema, lang=langs, x=xs)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the languages and the weights of all machines."""
    labels, vectors = [], []
    for batch in batches:
        labels += batch.column("lang").to_pylist()
        vectors += [np.frombuffer(v.as_buffer(), np.float32) for v in batch.column("x")]
    model = Model.fitted(np.vstack(vectors), np.array(labels, object)) if labels else Model([])
    table = np.vstack([model.weights, model.bias[None].astype(np.float32)])
    yield pa.RecordBatch.from_arrays([pa.array([model.langs], pa.list_(pa.string())), pa.array([table.tobytes()], pa.binary())], names=["langs", "weights"])


def training_sample(docs: DataFrame, train_per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """lang and text of the `train_per_lang` labelled documents of each language, outside the held-out part, that have the smallest
    hashes (fewer, if there are more than TRAIN_ROWS / train_per_lang languages)."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    most = max(1, min(train_per_lang, TRAIN_ROWS // max(1, len(counts))))
    if not counts:
        return rows.select("lang", "text").limit(0)
    order = F.xxhash64(F.col("doc_id"), F.lit(9))
    # of a large language only hashes below a bound that lets about four times as many pass as are wanted go on to the ranking
    bound = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, 4 * (most + 25) / n)))])
    near = rows.withColumn("h", order).where(F.col("h") / 2.0**64 + 0.5 < F.try_element_at(bound, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text")))
    return near.withColumn("n", rank).where(F.col("n") <= most).select("lang", "text")


def fit(docs: DataFrame, train_per_lang: int = TRAIN_PER_LANG) -> Model:
    """Fits on training_sample() in one task, which holds at most 3 * TRAIN_ROWS vectors; the driver gets the weights."""
    vectors = training_sample(docs, train_per_lang).mapInArrow(_vectors, "lang string, x binary")
    got = vectors.repartition(1).sortWithinPartitions("lang", "x").mapInArrow(_fitted, "langs array<string>, weights binary").first()
    if got is None:
        return Model([])
    return Model(got["langs"], np.frombuffer(bytes(got["weights"]), np.float32).reshape(FEATURES + 1, -1))


def predict(docs: DataFrame, model: Model, extra: Sequence[str] = (), result: tuple[str, str, str] = ("lang_pred", "score", "familiar")) -> DataFrame:
    """doc_id, the columns named in `extra`, passed through, and the prediction, its score, and whether the text may be in a learned language
    at all, named as in `result`."""
    names_out = list(dict.fromkeys(["doc_id", *extra]))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    source = docs.select(*dict.fromkeys([*names_out, "text"]))
    schema = ", ".join(f"`{x}` {fields[x]}" for x in names_out) + f", `{result[0]}` string, `{result[1]}` double, `{result[2]}` boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                text = batch.column("text")
                buf, offs = flat(text)
                letters = np.concatenate([[0], np.cumsum((LOWER[buf] >= 97) & (LOWER[buf] <= 122))])
                sure = letters[offs[1:]] > letters[offs[:-1]]
                known = [bool(s) or _has_letter(text[i].as_py()) for i, s in enumerate(sure)]
                if model.langs:
                    margins = model.margins(buf, offs)
                    langs, score = model.decide(margins)
                    familiar = model.familiar(margins, offs) & np.array(known, bool)
                else:
                    langs, score, known = ["und"] * len(offs), np.zeros(len(offs) - 1), [False] * (len(offs) - 1)
                    familiar = np.zeros(len(known), bool)
                langs = [x if k else "und" for x, k in zip(langs, known)]
                score = np.where(known, score, 0.0)
                arrays = [batch.column(x) for x in names_out] + [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(familiar)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names_out, *result])

    return source.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, train_per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """The documents, all columns, in an identified language: those that aren't `und` and whose features are frequent enough in the learned
    languages.  Encoded data, random letters and languages never learned go; documents in several learned languages stay.  Without
    labelled documents no language can be identified, so none stays.  Repeated rows fare alike."""
    got = predict(docs, fit(docs, train_per_lang), docs.columns, ("__lang", "__score", "__familiar"))
    return got.where((F.col("__lang") != "und") & F.col("__familiar")).select(*docs.columns)


def op9_lang_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; see the module for cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable] = {"op9_lang_id": op9_lang_id}
