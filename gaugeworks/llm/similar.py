"""Pairs of documents whose sets of five-word shingles have a Jaccard similarity of at least a bound.

SimHash fingerprints within a few bits mean nearly equal texts; documents that share four fifths of their shingles differ
in about ten bits, too many for an exact index.

1. Min-hashes settle the bulk: `bands` keys of `rows` minima each, every text paired with the first one of its key (a star),
   texts that fail there with the first and the last text of each triple of keys they failed under. Pairs are verified on the shingles.
2. An exact join finds what that leaves. All shingles have one order, the frequent ones last (by a sample; the order decides
   the cost, never the result). Two sets at the bound share m of the first (1 - similarity) n + m of each, for any m, so each
   of these is a key, and all pairs that share m keys are candidates, m = 1 + n / 64 of the smaller one, unless they are of one
   component already, or their sizes, the places of the keys or the distance of their parity bitmaps (at most the number of
   shingles that only one has) rule the bound out. Candidates are verified; keys of many texts are dealt to tasks by pairs of parts.

So the links connect exactly what all similar pairs connect; pairs inside a component may be left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy, whole
from .components import components
from .passages import Tokens


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minima(tokens: np.ndarray, n: int) -> np.ndarray:
    """The least of n keyed hashes over the tokens."""
    a, b = _salts(n)
    out = np.full(n, np.iinfo(np.uint64).max)
    for i in range(0, len(tokens), 1 << 14):
        x = tokens[i : i + (1 << 14), None] * a[None] + b[None]
        out = np.minimum(out, (x ^ (x >> np.uint64(29))).min(0))
    return out


def band_keys(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """(doc, n, key), n the distinct shingles: documents with fewer than five words have no shingles and no key."""

    def run(batches):
        import xxhash

        for b in batches:
            out = []
            for doc, text in zip(b["doc"], b["_text"]):
                x = Tokens.of(text)
                if len(x):
                    m = minima(x, bands * per_band).reshape(bands, per_band)
                    n = len(np.unique(x))
                    out += [(doc, n, xxhash.xxh64_intdigest(m[k].tobytes(), k) - (1 << 63)) for k in range(bands)]
            yield pd.DataFrame(out, columns=["doc", "n", "key"]).astype({"doc": "int64", "n": "int32", "key": "int64"})

    return rows.mapInPandas(tidy(run, "passages"), "doc long, n int, key long")


def _finer(keys: DataFrame, first: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): finer stars of the texts that failed against the first one of a key, around the first and the last of each triple of such keys.

    A text has a bounded number of triples, so this is linear; three keys in common set texts of a lower similarity apart.
    """
    failed = keys.join(first, "key").where("doc <> v").join(links.select(F.col("u").alias("doc"), "v"), ["doc", "v"], "left_anti")
    own = failed.groupBy("doc").agg(F.sort_array(F.collect_set("key")).alias("k")).where(F.size("k") >= 3)
    n = F.size("k")
    three = F.flatten(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.flatten(F.transform(F.sequence(i + 1, n - 2), lambda j: F.transform(
        F.sequence(j + 1, n - 1), lambda m: F.xxhash64(F.get(F.col("k"), i), F.get(F.col("k"), j), F.get(F.col("k"), m)))))))
    joint = scratch.keep(own.select("doc", F.explode(three).alias("key")), "joint")
    ends = joint.groupBy("key").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).where("_a <> _b")
    heads = scratch.keep(ends.select("key", F.explode(F.array("_a", "_b")).alias("v")), "heads")
    return joint.join(heads, "key").where("doc <> v").select(F.greatest("doc", "v").alias("u"), F.least("doc", "v").alias("v")).distinct()


#: Words of 64 bits in a parity bitmap.
MARK = 16
#: Shingles a text for each shared key that is asked for beyond the first.
SPARE = 64


def frequent(rows: DataFrame, sample: int = 10_000, least: int = 3, most: int = 200_000) -> np.ndarray:
    """Shingles of `least` or more of about `sample` texts, chosen by hash, the rarest first; `most` bounds the list."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"x": np.concatenate([np.zeros(0, np.uint64)] + [np.unique(Tokens.of(t)) for t in b["_text"]]).view(np.int64)})

    share = max(1, rows.count() // sample)
    some = rows.where(F.pmod("doc", F.lit(share)) == 0).dropDuplicates(["doc"]).mapInPandas(tidy(run, "passages"), "x long")
    found = some.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).orderBy(F.desc("c"), "x").limit(most).select("x").toPandas()
    return found["x"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def prefix_keys(rows: DataFrame, similarity: float, late: np.ndarray) -> DataFrame:
    """(doc, n, at, key): the first shingles in the common order, `late` ones last, at their places; n the distinct shingles.

    A row at -1 has the text's bitmap as `mark`.
    """
    by = np.argsort(late)
    value = np.append(late[by], np.uint64(2**64 - 1))
    rank = np.append(by, -1).astype(np.int32)

    def run(batches):
        for b in batches:
            out, marks = [], []
            for doc, text in zip(b["doc"], b["_text"]):
                x = np.unique(Tokens.of(text))
                n = len(x)
                if n:
                    i = np.searchsorted(value[:-1], x)
                    r = np.where(value[i] == x, rank[i], -1)
                    first = x[np.argsort(r, kind="stable")][: n - int(np.ceil(similarity * n - 1e-9)) + n // SPARE + 1].view(np.int64)
                    m = len(first) + 1
                    out.append((np.full(m, doc), np.full(m, n), np.arange(-1, m - 1), np.append(doc, first)))
                    marks += [bitmap(x)] + [None] * (m - 1)
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 4
            yield pd.DataFrame({k: c.astype(d) for k, c, d in zip(("doc", "n", "at", "key"), cols, ("int64", "int32", "int32", "int64"))}).assign(mark=marks)

    return rows.mapInPandas(tidy(run, "passages"), "doc long, n int, at int, key long, mark binary")


def bitmap(x: np.ndarray) -> bytes:
    """Parities of the numbers of shingles at each of 64 MARK bits."""
    odd = np.bincount((x >> np.uint64(20)).astype(np.int64) & (64 * MARK - 1), minlength=64 * MARK) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


GROUP = ["key", "_a", "_b"]


def _candidates(similarity: float, tile: int = 1 << 16):
    """Rows sorted by GROUP -> (u, v, spare), a row a key, of pairs that may be similar if more than `spare` keys say so. Holds one batch, the open group and a tile of pairs."""
    part = similarity / (1 + similarity)

    def solve(b):
        doc, n, at, own, c = (b[k].to_numpy(np.int64) for k in ("doc", "n", "at", "_own", "component"))
        cross = (b["_a"] != b["_b"]).to_numpy()
        mark = np.frombuffer(b"".join(b["mark"]), np.uint64).reshape(-1, MARK)
        k = b[GROUP].to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(1))), len(b))
        # Each row with the later ones of its group: all groups at once, a tile of pairs at a time.
        later = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(b)) - 1
        done = np.cumsum(later)
        p = 0
        while p < len(b):
            q = max(p + 1, int(np.searchsorted(done, (done[p - 1] if p else 0) + tile, "right")))
            many = later[p:q]
            i = np.repeat(np.arange(p, q), many)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            fit = (c[i] != c[j]) & (doc[i] != doc[j]) & ((own[i] != own[j]) | ~cross[i])
            i, j = i[fit], j[fit]
            need = part * (n[i] + n[j]) - 1e-6
            spare = np.minimum(n[i], n[j]) // SPARE
            fit = np.minimum(n[i] - at[i], n[j] - at[j]) + spare >= need
            i, j, need, spare = i[fit], j[fit], need[fit], spare[fit]
            near = np.bitwise_count(mark[i] ^ mark[j]).sum(1, dtype=np.int64) <= n[i] + n[j] - 2 * need
            i, j = i[near], j[near]
            if len(i):
                yield pd.DataFrame({"u": np.maximum(doc[i], doc[j]), "v": np.minimum(doc[i], doc[j]), "spare": spare[near].astype(np.int32)})
            p = q

    def run(batches):
        held = []
        for b in batches:
            if not len(b):
                continue
            k = b[GROUP].to_numpy()
            if held and (held[0][GROUP].iloc[0].to_numpy() == k[-1]).all():
                held.append(b)
                continue
            b = pd.concat([*held, b], ignore_index=True)
            k = b[GROUP].to_numpy()
            other = np.flatnonzero((k != k[-1]).any(1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from solve(b.iloc[:cut])
            held = [b.iloc[cut:]]
        if held:
            yield from solve(pd.concat(held, ignore_index=True))

    return run


def _rest(rows: DataFrame, links: DataFrame, similarity: float, scratch: Scratch, limit: int) -> DataFrame:
    """(u, v): candidates of the exact join between components of links."""
    keys = prefix_keys(rows, similarity, frequent(rows))
    of = Window.partitionBy("key")
    shared = keys.withColumn("_both", F.min("doc").over(of) != F.max("doc").over(of)).where("_both or at < 0").drop("_both")
    shared = scratch.keep(shared, "shared")
    marks = shared.where("at < 0").groupBy("doc").agg(F.first("mark").alias("mark"))
    named = components(links, scratch).select(F.col("node").alias("doc"), "component")
    live = shared.where("at >= 0").select("doc", "n", "at", "key").distinct().join(named, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    live = scratch.keep(live, "live")
    # Keys of one component are settled.
    mixed = live.groupBy("key").agg(F.min("component").alias("_x"), F.max("component").alias("_y"), F.count(F.lit(1)).alias("_n")).where("_x <> _y").select("key", "_n")
    parts = F.ceil(F.col("_n") / limit).cast("int")
    dealt = live.join(scratch.keep(mixed, "mixed"), "key").join(marks, "doc").select(
        "key", "doc", "n", "at", "component", "mark", F.pmod(F.xxhash64("doc"), parts).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_other")
    )
    keyed = dealt.withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other")}).drop("_other")
    found = keyed.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInPandas(tidy(_candidates(similarity)), "u long, v long, spare int")
    return scratch.keep(found.groupBy("u", "v").agg(F.count(F.lit(1)).alias("_n"), F.min("spare").alias("spare")).where("_n > spare").select("u", "v"), "rest")


def similar_pairs(
    docs: DataFrame, scratch: Scratch, text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 8, per_band: int = 4, limit: int = 2048
) -> DataFrame:
    """(u, v): fingerprints of verified pairs, which connect all texts that similar pairs connect.

    A text is known by its hash; should two texts have one hash, both are compared wherever one would be. Keys of more
    than `limit` texts are dealt in parts.
    """
    rows = docs.select(F.xxhash64(whole(text_col)).alias("doc"), whole(text_col).alias("_text"))
    keys = scratch.keep(band_keys(rows, bands, per_band).distinct(), "keys")
    first = scratch.keep(keys.groupBy("key").agg(F.min("doc").alias("v"), F.max("doc").alias("_m")).where("v <> _m").select("key", "v"), "first")
    pairs = scratch.keep(keys.join(first, "key").where("doc <> v").select(F.col("doc").alias("u"), "v").distinct(), "pairs")

    def shingles(batches):
        from .simhash import fingerprint

        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b["_text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc": b["doc"], "fp": fp, "x": [np.unique(Tokens.of(t)).tobytes() for t in b["_text"]]})

    def sets_of(some):
        some = scratch.keep(some.select(F.col("u").alias("doc")).unionByName(some.select(F.col("v").alias("doc"))).distinct(), "needed")
        # Repeats of a text are one row from here on.
        texts = some.join(rows, "doc").groupBy("doc", F.xxhash64(F.lit(1), "_text").alias("_h")).agg(F.first("_text").alias("_text"))
        return scratch.keep(texts.select("doc", "_text").mapInPandas(tidy(shingles, "passages"), "doc long, fp long, x binary"), "sets")

    def verify(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(same >= similarity * (len(p) + len(q) - same) - 1e-9)
            yield b.loc[keep, ["u", "v", "fu", "fv"]]

    def verified(some, sets):
        left = sets.select(F.col("doc").alias("u"), F.col("fp").alias("fu"), "x")
        right = sets.select(F.col("doc").alias("v"), F.col("fp").alias("fv"), F.col("x").alias("y"))
        both = some.join(left, "u").join(right, "v").select("u", "v", "fu", "fv", "x", "y")
        return scratch.keep(both.mapInPandas(tidy(verify), "u long, v long, fu long, fv long"), "links")

    sets = sets_of(pairs)
    links = verified(pairs, sets)
    rest = _finer(keys, first, links.select("u", "v"), scratch).join(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti")
    links = scratch.keep(links.unionByName(verified(scratch.keep(rest, "rest"), sets)), "links")
    rest = _rest(rows, links.select("u", "v"), similarity, scratch, limit)
    links = links.unionByName(verified(rest, sets_of(rest)))
    return links.select(F.col("fu").alias("u"), F.col("fv").alias("v"))
