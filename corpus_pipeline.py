"""Corpus pipeline: filter, deduplicate, mix and pack `documents`.

Every stage is written as Parquet to the shared folder and read again as the next stage's docs. The stages fit models
and link near copies, which SQL can't express, so there is no ORACLE_SQL; tests hold each stage against brute force.
"""

from __future__ import annotations

from gaugeworks.llm.common import Scratch, documents
from gaugeworks.llm.exact_dedup import drop_exact_duplicates
from gaugeworks.llm.mixing import mix
from gaugeworks.llm.packing import pack_documents
from gaugeworks.llm.quality import keep_good
from gaugeworks.llm.simhash import keep_one_of_each_group


def quality(spark, docs, sf_dir):
    """Rejects what the weakly labelled scorer calls bad."""
    return keep_good(docs)


def exact(spark, docs, sf_dir):
    """Of equal texts, the row with the largest id stays."""
    return drop_exact_duplicates(docs)


def near(spark, docs, sf_dir):
    """Of each group of near copies, the row with the smallest id stays."""
    return keep_one_of_each_group(docs)


def mixing(spark, docs, sf_dir):
    """Leaves documents out so that the labelled domains meet their weights; none is repeated."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), max_rate=1.0)


def packing(spark, docs, sf_dir):
    """Token pieces with their places in training sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
