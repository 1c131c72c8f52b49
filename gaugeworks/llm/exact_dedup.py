"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after lower-casing A-Z only; null counts as the empty text. The two first
levels shuffle two numbers a row. Only rows whose (length, prefix) occurs more than once carry their text
to the third level, where the SHA-256 of the whole text decides. The keys of each level that occur again are written to
the shared folder, so that both sides of the joins with them are plain exchanges, whose hot partitions adaptive
execution splits; all group sizes come from aggregates with map-side partial sums.

Defined cases: null text = empty text; null ids never win over an id, and a group of null ids only keeps a
null id's row as (keep_id null, kept true); rows repeated with the same id are counted in group_size and all
say the same; an empty table gives an empty result; other columns are ignored, whatever their names.
drop_exact_duplicates decides by row, not by id: exactly one row of each group of equal texts stays, that with the largest
id (nulls last), of several with that id the one with the largest hash of the whole row; of wholly equal rows any one. An id
that other texts carry too loses none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, documents, row_keys, whole, without_rows


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, keys: list[str] = ()) -> DataFrame:
    """One row per group of two or more equal texts: _sha, keep_id (the largest id), group_size, _best (largest of id and `keys`)."""
    text = whole(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).alias("_len"),
        F.xxhash64(ascii_lower(F.substring(text, 1, prefix_chars))).alias("_prefix"), F.struct(F.col(id_col).alias("_id"), *keys).alias("_row"),
    )
    again = lambda df, keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    scratch = Scratch(docs.sparkSession)
    by_length = scratch.keep(again(rows, ["_len"]), "lengths")
    # Grouped by an expression of the join key: the counts then cross an exchange of their own, after partial sums.
    refined = rows.join(by_length, "_len", "left_semi").select(F.concat_ws(":", "_len", "_prefix").alias("_key"))
    parts = F.split("_key", ":")
    by_prefix = scratch.keep(again(refined, ["_key"]).select(parts[0].cast("int").alias("_len"), parts[1].cast("long").alias("_prefix")), "prefixes")
    survivors = rows.join(by_prefix, ["_len", "_prefix"], "left_semi")
    return (
        survivors.groupBy("_len", F.sha2(ascii_lower(F.col("_text")), 256).alias("_sha"))
        .agg(F.max("_row").alias("_best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1").select("_sha", F.col("_best._id").alias("keep_id"), "group_size", "_best")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """Every row's id with text_sha256 (of the normalised text), keep_id, group_size and kept."""
    groups = duplicate_groups(docs, id_col, text_col, prefix_chars).drop("_best")
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(ascii_lower(whole(text_col)), 256).alias("_sha"))
    out = rows.join(groups, "_sha", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("_id").alias("doc_id"),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("keep_id").eqNullSafe(F.col("_id"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest id; all columns stay."""
    scratch = Scratch(docs.sparkSession)
    keyed, keys = row_keys(docs)
    groups = scratch.keep(duplicate_groups(keyed, id_col, text_col, keys=keys).select("_sha", "_best"), "groups")
    rows = keyed.select(F.sha2(ascii_lower(whole(text_col)), 256).alias("_sha"), F.struct(F.col(id_col).alias("_id"), *keys).alias("_row"))
    members = rows.join(groups, "_sha").select("_row", (F.col("_row") == F.col("_best")).alias("_wins"))
    counts = scratch.keep(members.groupBy(*[F.col(f"_row.{k}").alias(k) for k in keys], "_wins").agg(F.count(F.lit(1)).alias("_n")), "members")
    return without_rows(keyed, keys, counts.where("not _wins").select(*keys), counts.where("_wins and _n > 1").select(*keys))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


OP6_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, sha256(s) AS text_sha256
FROM t
"""
