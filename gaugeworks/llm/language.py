"""Language identification: nearest of several clustered centroids per language, on TF-IDF n-gram vectors.

A text is its letters, lower-cased, with every run of other characters as one gap. Hashed counts of two- and three-letter
sequences, damped and weighted by inverse document frequency, make a unit vector. Spherical k-means clusters each
language's training vectors into `clusters` centroids; a text gets the language of the nearest centroid by cosine. A text
further from it than nearly all (`tail`) of that language's training texts is marked rejected.

The classifier is fitted on a bounded sample: of each language the training rows with the least hash of id and text, at most
`sample` of a language and `total` in all, the same number for each; so a rare language is learned from all its rows.

Defined cases: null texts and texts without letters are `und` with score 0; so is everything where nothing could be learned;
rows with null language are never learned from; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, whole

SLOTS = 1 << 12
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Code point -> lower-case letter's code point, 0 for other characters; from Python's own tables."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


class Grams:
    """Hashed n-gram counts of whole texts."""

    table: np.ndarray | None = None

    @classmethod
    def counts(cls, text: str) -> np.ndarray | None:
        """None without letters."""
        if cls.table is None:
            cls.table = _letters()
        code = cls.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        solid = code != 0
        if not solid.any():
            return None
        keep = solid.copy()
        keep[1:] |= solid[:-1]
        code = np.concatenate([np.zeros(1, np.uint32), code[keep], np.zeros(1, np.uint32)])
        two = code[:-1] * np.uint32(0x9E3779B1) ^ code[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) ^ code[2:] * np.uint32(0x27D4EB2F)
        shift = np.uint32(32 - 12)
        return np.bincount((two * np.uint32(0x165667B1)) >> shift, minlength=SLOTS) + np.bincount((three * np.uint32(0x165667B1)) >> shift, minlength=SLOTS)


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; starts from the first vector and then the one furthest from those taken."""
    centre = [x[0]]
    while len(centre) < min(k, len(x)):
        centre.append(x[(x @ np.array(centre).T).max(1).argmin()])
    c = np.array(centre)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Model:
    """idf, centroids with their languages, and each language's least accepted cosine."""

    def __init__(self, counts: np.ndarray, langs: list[str], clusters: int, tail: float):
        n = len(langs)
        self.idf = (np.log((n + 1) / ((counts > 0).sum(0) + 1)) + 1).astype(np.float32) if n else np.ones(SLOTS, np.float32)
        self.langs: list[str] = []
        centres, self.floor = [], {}
        x = unit(counts.astype(np.float32), self.idf) if n else counts
        names = np.array(langs, dtype=object)
        for lang in sorted(set(langs)):
            own = x[names == lang]
            c = cluster(own, clusters)
            centres.append(c)
            self.langs += [lang] * len(c)
            self.floor[lang] = float(np.quantile((own @ c.T).max(1), tail)) - 0.02
        self.centres = np.concatenate(centres).astype(np.float32) if centres else np.zeros((0, SLOTS), np.float32)

    def predict(self, texts) -> list[tuple[str, float, bool]]:
        out = []
        for t in texts:
            c = Grams.counts(t) if self.langs and t else None
            if c is None:
                out.append((UNKNOWN, 0.0, True))
                continue
            cos = self.centres @ unit(c.astype(np.float32), self.idf)
            best = int(cos.argmax())
            out.append((self.langs[best], float(min(max(cos[best], 0.0), 1.0)), bool(cos[best] < self.floor[self.langs[best]])))
        return out


def fit_language(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = 3, sample: int = 750, total: int = 6000, tail: float = 0.005) -> Model:
    """rows: training rows only."""

    usable = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")
    )
    counts = usable.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    langs = counts.count()
    each = max(1, min(sample, total // max(langs, 1)))
    # Rows under a hash bound that about four times the sample of their language meets (all, if fewer), then the least hashes of them.
    bound = F.when(F.col("_n") > 8 * each, F.lit(4.0 * each) / F.col("_n")).otherwise(1.0)
    counts = counts.select(F.col("_lang").alias("_l"), bound.alias("_bound"))
    share = (F.col("_h").cast("double") + 2.0**63) / 2.0**64

    def describe(batches):
        for b in batches:
            made = [(h, lang, c) for h, lang, t in zip(b["_h"], b["_lang"], b["_text"]) if (c := Grams.counts(t)) is not None]
            yield pd.DataFrame({"_h": [m[0] for m in made], "lang": [m[1] for m in made], "x": [np.minimum(m[2], 60000).astype(np.uint16).tobytes() for m in made]}).astype({"_h": "int64"})

    counts = F.broadcast(counts) if langs <= 10_000 else counts
    usable = usable.join(counts, F.col("_lang") == F.col("_l")).where(share <= F.col("_bound")).select("_h", "_text", "_lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    taken = usable.mapInPandas(describe, "_h long, lang string, x binary").withColumn("_k", place).where(F.col("_k") <= each).limit(total + langs).orderBy("_h", "lang").toPandas()
    x = np.stack([np.frombuffer(b, np.uint16) for b in taken["x"]]) if len(taken) else np.zeros((0, SLOTS), np.uint16)
    return Model(x, list(taken["lang"]), clusters, tail)


def predict_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(held.value.predict(b["_text"]), columns=["lang_pred", "score", "rejected"])], axis=1)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).mapInPandas(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def fold(col):
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 3


def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = predict_language(docs, fit_language(docs.where(fold(F.col("doc_id")) != 1)))
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "rejected")
