"""Trains an index from labelled vectors and saves it: python -m vectorvote.build REFERENCES.json[.gz] INDEX [--binary FILE]

Defaults are the offline preset (4,096 clusters, seeds from 50,000 vectors, up to 25 rounds).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .config import DIMENSIONS, TrainConfig
from .operators import ivf
from .sources.readers import read_references


def build_index(references: DataFrame, path: str, config: TrainConfig | None = None, binary: str | None = None) -> ivf.IvfIndex:
    """Indexes (ref_id, vector, label), writes the Parquet index and, if asked for, the exchange format."""
    index = ivf.train_index(references, config or TrainConfig.offline())
    index.save(path)
    if binary:
        ivf.export_binary(index, binary)
    return index


def main(arguments: list[str] | None = None) -> None:
    preset = TrainConfig.offline()
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("references")
    parser.add_argument("index")
    parser.add_argument("--binary")
    parser.add_argument("--clusters", type=int, default=preset.clusters)
    parser.add_argument("--sample", type=int, default=preset.sample)
    parser.add_argument("--rounds", type=int, default=preset.rounds)
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    rows = read_references(spark, args.references, DIMENSIONS)
    build_index(rows, args.index, TrainConfig.offline(clusters=args.clusters, sample=args.sample, rounds=args.rounds), args.binary)


if __name__ == "__main__":
    main()
