"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints: 64 bits, bit i is 1 if set in over half the XXH64 hashes (seed 42) of the text's word shingles.
Distinct fingerprints link at `radius` or fewer differing bits; every link is found, no candidate is capped:

1. Of b blocks of the 64 bits, two linked fingerprints share b - radius in full. Each distinct fingerprint is filed once
   for each choice of those blocks, under the masked pattern: the upper nodes of the index. b follows from the count
   of fingerprints, so that a node holds a bounded number on average.
2. A node over `node_limit` is dealt into chunks and each pair of chunks is one task's share.
3. Inside a node, fingerprints are sorted by Gray rank. Runs that share their first 12, 24, 40 and 64 bits are the
   lower nodes. Pairs of nodes are walked from the top, summing differing bits; a pair over the radius is pruned with
   all below it, as is a pair whose members are already known to be in one group. What is left are links, and a
   node's links leave as a star, not as pairs.
4. Stars are joined into components in the cluster (components.py).

The graph's vertices are the fingerprints, so ids needn't be unique: a component's name is its rows' smallest id.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle: the whole
sequence is the one shingle; rows with null id share their fingerprint's component but are nobody's representative (a
component of null ids only has null as its name); rows of one id with unlike texts stay in different components; an empty
table gives an empty result; repeated rows give repeated results; other columns are ignored. keep_one_of_each_group decides
by row, not by id: of each component exactly one row stays, that with the smallest id (nulls last), of several with that id
the one with the smallest hash of the whole row; of wholly equal rows any one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, row_keys, tidy, whole, without_rows
from .components import components
from .similar import similar_pairs

SEED = 42
SEGMENTS = (12, 24, 40, 64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned fingerprint of a whole text."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    w = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(start[: len(parts) - w + 1].tolist(), stop[w - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, keys: list[str] = ()) -> DataFrame:
    """doc_id, the columns `keys` and fp (the fingerprint as a signed long)."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b["_text"]], np.uint64).view(np.int64)
            yield b.drop(columns="_text").assign(fp=fp)

    rows = docs.select(F.col(id_col).alias("doc_id"), *keys, whole(text_col).alias("_text"))
    fields = "".join(f"`{n}` {kind}, " for n, kind in rows.dtypes[:-1])
    return rows.mapInPandas(tidy(run), fields + "fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    out = fp.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        out = out ^ (out >> np.uint64(s))
    return out


class GrayIndex:
    """Fingerprints of one or more groups, in Gray order, as levels of runs with a shared masked pattern."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), group))
        self.order, self.fp, group = order, fp[order], group[order]
        self.levels = []  # for each level: first row of each node, pattern of the segment, first child
        edge_before = None
        for level, bits in enumerate(SEGMENTS):
            prefix = self.fp >> np.uint64(64 - bits)
            new = np.ones(len(fp), bool)
            new[1:] = (prefix[1:] != prefix[:-1]) | (group[1:] != group[:-1])
            first = np.flatnonzero(new)
            below = SEGMENTS[level - 1] if level else 0
            segment = prefix[first] & np.uint64((1 << (bits - below)) - 1)
            if edge_before is not None:
                self.levels[-1].append(np.searchsorted(first, np.append(edge_before, len(fp))))
            self.levels.append([first, segment])
            edge_before = first
        self.levels[-1].append(np.append(edge_before, len(fp)))
        self.roots = group[self.levels[0][0]]

    def link(self, radius: int, share: int = 1 << 20) -> np.ndarray:
        """For each row of the input, a row of its group that it reaches by links (itself if none)."""
        n = len(self.fp)
        lab = np.arange(n)
        big = n > 4096
        # The first stack entries pair each root with itself and its later siblings.
        cut = np.flatnonzero(np.append(True, self.roots[1:] != self.roots[:-1]))
        stop = np.repeat(np.append(cut[1:], len(self.roots)), np.diff(np.append(cut, len(self.roots))))
        a = np.arange(len(self.roots))
        stack = []
        size = np.cumsum(stop - a)
        for lo, hi in self._slices(size, share):
            stack.append((-1, a[lo:hi], stop[lo:hi], None))
        while stack:
            level, i, j, d = stack.pop()
            if level < 0:
                left, right = self._spread(i, i, i + 1, j)
                keep = slice(None)
                dist = np.zeros(len(left), np.int64)
            else:
                first, _, child = self.levels[level]
                if big:
                    low, high = np.minimum.reduceat(lab, first), np.maximum.reduceat(lab, first)
                    done = (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])
                    i, j, d = i[~done], j[~done], d[~done]
                if not len(i):
                    continue
                counts = (child[i + 1] - child[i]) * (child[j + 1] - child[j])
                if len(i) > 1 and counts.sum() > share:
                    for lo, hi in self._slices(np.cumsum(counts), share):
                        stack.append((level, i[lo:hi], j[lo:hi], d[lo:hi]))
                    continue
                left, right, src = self._product(child, i, j, counts)
                same = i[src] == j[src]
                keep = ~same | (left <= right)
                dist = d[src]
            left, right, dist = left[keep], right[keep], dist[keep]
            segment = self.levels[level + 1][1]
            dist = dist + np.bitwise_count(segment[left] ^ segment[right])
            near = dist <= radius
            left, right, dist = left[near], right[near], dist[near]
            if level + 2 < len(SEGMENTS):
                if len(left):
                    stack.append((level + 1, left, right, dist))
            else:
                first = self.levels[-1][0]
                self._join(lab, first[left], first[right])
        out = np.empty(n, np.int64)
        out[self.order] = self.order[lab]
        return out

    @staticmethod
    def _slices(total: np.ndarray, share: int):
        """Ranges of about `share` counts each (running totals given); two or more where the whole is over it."""
        if len(total) < 2 or total[-1] <= share:
            return [(0, len(total))] if len(total) else []
        cuts = np.clip(np.searchsorted(total, np.arange(share, total[-1], share)), 1, len(total) - 1)
        cuts = np.unique(np.concatenate([[0], cuts, [len(total)]]))
        return list(zip(cuts[:-1], cuts[1:]))

    @staticmethod
    def _spread(i, lo, _, hi):
        """Pairs (i, x) for lo <= x < hi."""
        n = hi - lo
        src = np.repeat(np.arange(len(i)), n)
        return i[src], lo[src] + np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)

    @staticmethod
    def _product(child, i, j, counts):
        src = np.repeat(np.arange(len(i)), counts)
        k = np.arange(len(src)) - np.repeat(np.cumsum(counts) - counts, counts)
        wide = (child[j + 1] - child[j])[src]
        return child[i][src] + k // wide, child[j][src] + k % wide, src

    @staticmethod
    def _join(lab, a, b) -> None:
        """Unites the rows a[x] and b[x]; lab stays a flat forest with the least row as root."""
        while True:
            x, y = lab[a], lab[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
            while True:
                flat = lab[lab]
                if (flat == lab).all():
                    break
                lab[:] = flat


def blocks_for(count: int, radius: int, load: int = 512) -> int:
    """Fewest blocks whose node pattern leaves `load` fingerprints a node on average."""
    b = radius + 1
    while b < 64 and count / 2 ** (64 * (b - radius) / b) > load and b < 2 * radius + 2:
        b += 1
    return b


def block_masks(blocks: int, radius: int) -> list[int]:
    edge = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    masks = [sum(c) for c in combinations(one, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _stars(batches, radius: int):
    """Rows sorted by node -> star edges (u, v) of each node's linked vertices. Holds one batch and the open node."""
    import pandas as pd

    held = None
    key = ["_mask", "_pattern", "_a", "_b"]

    def solve(b):
        if len(b) < 2:
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
        k = b[key].to_numpy()
        group = np.cumsum(np.append(0, (k[1:] != k[:-1]).any(axis=1)))
        v = b["v"].to_numpy()
        root = GrayIndex(group, b["fp"].to_numpy().view(np.uint64)).link(radius)
        away = root != np.arange(len(b))
        return pd.DataFrame({"u": v[away], "v": v[root[away]]})

    for b in batches:
        if not len(b):
            continue
        if held is not None:
            b = pd.concat([held, b], ignore_index=True)
        k = b[key].to_numpy()
        last = np.flatnonzero((k != k[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        held = b.iloc[cut:]
        if cut:
            yield solve(b.iloc[:cut])
    if held is not None:
        yield solve(held)


def near_edges(points: DataFrame, count: int, radius: int = 4, node_limit: int = 4096) -> DataFrame:
    """points: distinct fp with its vertex v. Star edges (u, v) that connect what links connect."""
    masks = block_masks(blocks_for(count, radius), radius)
    filed = points.select("fp", "v", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("_mask", "_bits")).select(
        "fp", "v", "_mask", F.col("fp").bitwiseAND(F.col("_bits")).alias("_pattern")
    )
    heavy = filed.groupBy("_mask", "_pattern").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > node_limit)
    parts = F.ceil(F.col("_n") / node_limit).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.coalesce(parts, F.lit(1))).cast("int")
    dealt = filed.join(heavy, ["_mask", "_pattern"], "left").select(
        "fp", "v", "_mask", "_pattern", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)).alias("_other")
    )
    keyed = dealt.select("fp", "v", "_mask", "_pattern", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"))
    key = ["_mask", "_pattern", "_a", "_b"]
    sorted_ = keyed.repartition(*key).sortWithinPartitions(*key)
    return sorted_.mapInPandas(lambda batches: _stars(batches, radius), "u long, v long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, node_limit: int = 4096, similarity: float | None = None, keys: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """doc_id, `keys`, fp of every row, and (fp, component), component a fingerprint of the component, of the linked fingerprints.

    With `similarity`, verified pairs of that Jaccard similarity link too (similar.py).
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(fingerprints(docs, id_col, text_col, words, keys), "prints")
    points = scratch.keep(prints.select("fp", F.col("fp").alias("v")).distinct(), "points")
    edges = near_edges(points, points.count(), radius, node_limit)
    if similarity is not None:
        edges = edges.unionByName(similar_pairs(docs, scratch, text_col, words, similarity))
    return prints, scratch.keep(components(edges, scratch).select(F.col("node").alias("_fp"), "component"), "components")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, fp and component_id (the smallest id of the component) of every row."""
    prints, linked = simhash_groups(docs, id_col, text_col, **options)
    # Ids are gathered by fingerprint first: two small aggregates, and one join of the rows.
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("v"))
    named = points.join(linked, points["fp"] == linked["_fp"], "left").select(F.col("fp").alias("_fp"), "v", F.coalesce("component", "fp").alias("_c"))
    named = Scratch(docs.sparkSession).keep(named, "named")
    least = named.groupBy("_c").agg(F.min("v").alias("component_id"))
    ids = named.join(least, "_c").select("_fp", "component_id")
    return prints.join(ids, prints["fp"] == ids["_fp"]).select("doc_id", "fp", "component_id")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4, similarity: float | None = 0.8) -> DataFrame:
    """docs with one row of each component, the one with the smallest id; all columns stay."""
    keyed, keys = row_keys(docs)
    scratch = Scratch(docs.sparkSession)
    prints, linked = simhash_groups(keyed, id_col, text_col, words, radius, similarity=similarity, keys=keys)
    rows = prints.join(linked, prints["fp"] == linked["_fp"], "left").select(
        F.coalesce("component", "fp").alias("_c"), F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", *keys).alias("_row")
    )
    rows = scratch.keep(rows.groupBy("_c", "_row").agg(F.count(F.lit(1)).alias("_n")), "rows")
    best = scratch.keep(rows.groupBy("_c").agg(F.min("_row").alias("_best"), F.sum("_n").alias("_all")).where("_all > 1").select("_c", "_best"), "best")
    members = scratch.keep(rows.join(best, "_c").select(*[F.col(f"_row.{k}").alias(k) for k in keys], "_n", (F.col("_row") == F.col("_best")).alias("_wins")), "members")
    return without_rows(keyed, keys, members.where("not _wins").select(*keys), members.where("_wins and _n > 1").select(*keys))


def op3_simhash_neardup(spark, sf_dir):
    found = near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
