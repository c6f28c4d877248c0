"""Candidate pairs of documents confirmed on their full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.text import pieces, shingle_sets
from creditloom.sources.intermediate import materialise, release

# Documents confirmed against one copy of the text of the document that they met.
MEETING = 256


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the stored pairs (a, b) whose full sets reach the similarity, stored; the copy of their texts goes again.

    The text of ``a`` travels once for ``MEETING`` partners, who stream past its set.
    """
    concerned = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = materialise(texts.join(concerned.hint("merge"), "doc_id", "left_semi"), "texts")
    rounds = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEETING).alias("rounds"))
    met = pairs.join(rounds.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("rounds")).alias("round"))
    hosts = met.select("a", "round").distinct().join(texts.withColumnRenamed("doc_id", "a").hint("merge"), "a")
    guests = met.join(texts.withColumnRenamed("doc_id", "b").hint("merge"), "b")
    columns = ["a", "round", "b", "text"]
    seated = guests.select(columns).unionByName(hosts.withColumn("b", F.lit(None).cast("long")).select(columns))
    seated = seated.repartition("a", "round").sortWithinPartitions("a", "round", F.col("b").asc_nulls_first())

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = np.zeros(0, np.uint64)
        for batch in batches:
            for part in pieces(batch):
                hashes, begins = shingle_sets(part, width)
                good = []
                for i, guest in enumerate(part.column("b").to_pylist()):
                    own = hashes[begins[i] : begins[i + 1]]
                    if guest is None:
                        host = own
                    shared = len(np.intersect1d(host, own, assume_unique=True)) if guest is not None else 0
                    good.append(guest is not None and 100 * shared >= percent * (len(host) + len(own) - shared))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    found = materialise(seated.mapInArrow(confirm, "a long, b long"), "similar")
    release(texts)
    return found
