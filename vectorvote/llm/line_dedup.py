"""Line deduplication by overlapping three-line windows.

Each run of three consecutive lines that aren't blank is hashed to 128 bits.  Windows that occur more than once in the corpus are found
by one aggregation; the first occurrence, by (doc_id, text hash, position), stays, and every line that a later
occurrence covers is removed.  Overlapping occurrences merge, since lines are covered once.

Only hashes and positions are shuffled for the search.  A very common window is reduced map-side to its count and
its smallest occurrence; the join that finds the later ones has one row a window on its build side, and its
skewed stream side is split by adaptive execution.

Defined results: lines are separated by "\\n" and compared byte by byte; a line of white space only is blank, is never
part of a window and never removed.  Texts with fewer than three such lines keep all lines; null text stays null, with
no lines.  Repeated rows (equal doc_id and text) count as one document: none removes lines from the other, and each is
returned.  A null doc_id sorts first.  An empty table gives an empty result.  A very long text is a slice by itself, handled whole, in
memory in proportion to its length.  Extra columns pass through `dedup_lines`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import BLANK_WORDS, as_table, flat, slices, span_hashes, windows

SIZE = 3


def _lines(buf: np.ndarray, offs: np.ndarray):
    """Start, end and document of every line of a slice, and whether it isn't blank."""
    breaks = np.flatnonzero(buf == 10)
    doc = np.searchsorted(offs, breaks, "right") - 1
    full = np.flatnonzero(np.diff(offs) > 0)
    start = np.concatenate([offs[:-1][full], breaks + 1])
    end = np.concatenate([offs[1:][full], breaks])
    owner = np.concatenate([full, doc])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    end = np.sort(end)
    ink = np.concatenate([[0], np.cumsum(BLANK_WORDS[buf])])
    return start, end, owner, ink[end] > ink[start]


def line_windows(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), pos (of the first line, among those that aren't blank), h and g (two hashes): a row for each window."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                buf, offs = flat(batch.column("text"))
                start, end, owner, ink = _lines(buf, offs)
                start, end, owner = start[ink], end[ink], owner[ink]
                if len(start) < SIZE:
                    continue
                h, g = (windows(span_hashes(buf, start, end, key), SIZE) for key in (0, 1))
                same = np.flatnonzero(owner[: len(h)] == owner[SIZE - 1 :])
                first = np.searchsorted(owner, np.arange(batch.num_rows))
                rows = owner[same]
                yield as_table(schema, doc_id=batch.column("doc_id").take(pa.array(rows)), th=batch.column("th").take(pa.array(rows)), pos=(same - first[rows]).astype(np.int32), h=h[same].view(np.int64), g=g[same].view(np.int64))

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id bigint, th bigint, pos int, h bigint, g bigint")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, at: for each document with later occurrences, the positions at which they begin."""
    found = line_windows(docs)
    place = F.struct("doc_id", "th", "pos")
    groups = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(groups, ["h", "g"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("at"))


def dedup_lines(docs: DataFrame, report: bool = False) -> DataFrame:
    """The documents, all columns, without later occurrences of repeated windows; n_chars follows the text, if there.

    With report=True: also n_lines, n_removed.
    """
    at = repeated_lines(docs).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("at").alias("__at"))
    both = docs.join(at, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th")), "left").drop("__id", "__th")
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                column, where = batch.column("text"), batch.column("__at")
                buf, offs = flat(column)
                owner = _lines(buf, offs)[2]
                total = np.bincount(owner, minlength=batch.num_rows)
                removed = np.zeros(batch.num_rows, np.int64)
                texts = column
                hit = np.flatnonzero(~np.asarray(where.is_null().to_numpy(zero_copy_only=False)))
                if len(hit):
                    texts = column.to_pylist()
                    for i in hit:
                        lines = texts[i].split("\n")
                        gone = np.zeros(len(lines) + SIZE, dtype=bool)
                        for k in range(SIZE):
                            gone[np.asarray(where[i].values) + k] = True
                        kept, p = [], -1
                        for line in lines:
                            ink = bool(line.strip(" \t\n\x0b\x0c\r"))
                            p += ink
                            if not (ink and gone[p]):
                                kept.append(line)
                        removed[i] = len(lines) - len(kept)
                        texts[i] = "\n".join(kept)
                    texts = pa.array(texts, pa.string())
                arrays = [texts if x == "text" else batch.column(x) for x in names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(total.astype(np.int64)), pa.array(removed)], names=[*names, "__lines", "__gone"])

    out = both.mapInArrow(run, fields + ", __lines bigint, __gone bigint")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__gone") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.withColumnsRenamed({"__lines": "n_lines", "__gone": "n_removed"}) if report else out.drop("__lines", "__gone")


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the hash of the remaining text, for every document; see the module for cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, report=True).select("doc_id", "n_lines", "n_removed", digest(F.col("text")).alias("text_sha256"))


QUERIES: dict[str, Callable] = {"op7_line_dedup": op7_line_dedup}
ORACLE = {
    "op7_line_dedup": """
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, regexp_matches(ls[i], '[^ \\t\\n\\x0B\\f\\r]') AS ink
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''))
), nb AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE ink
), w AS (
  SELECT doc_id, p, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS w
  FROM nb WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM w WHERE w IS NOT NULL) WHERE k > 1
), covered AS (
  SELECT DISTINCT doc_id, p + k AS p FROM later, (SELECT unnest([0, 1, 2]) AS k)
), gone AS (
  SELECT doc_id, i FROM nb JOIN covered USING (doc_id, p)
)
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed, sha256(coalesce(x.t, '')) AS text_sha256
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS t
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
) x ON d.doc_id = x.doc_id
"""
}
