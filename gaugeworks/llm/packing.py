"""Best-fit packing of tokenized documents by a linear grouping scheme.

Documents become pieces of at most `capacity` ids. Documents of one length are interchangeable, so packing is solved
exactly on the length histogram - at most `capacity` rows, whatever the corpus - and documents take places by their
rank within their length:

1. Lengths over capacity / `large_share` are sorted down and grouped by equal cardinality; each group is rounded up to its
   largest length, which leaves few sizes.
2. Configurations: the largest size left takes the fullest combination of the sizes left (subset sums as bit sets),
   used as often as the counts allow.
3. Actual lengths replace the rounded ones; bins with equal content stay one run-length coded segment.
4. Small lengths go best-fit, largest first, into the tightest bins; then into new ones.

The grouping with the fewest bins of a few tried is taken. What the driver holds is bounded by capacity and the
number of groups. Ranks come from windows over (length, hash bucket) with about the square root of the piece count as
buckets, so no length lands in one task.

Defined cases: null text = empty text = the one id 0; longer documents alone are cut; repeated rows are packed once each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, Scratch, documents, tidy, whole

CAPACITY = 2048
END = b"\0\0\0\0"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memo(dict):
    """Computes what it lacks; forgets everything when full."""

    def __init__(self, make, room: int):
        self.make, self.room = make, room

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) < 64:
            if len(self) >= self.room:
                self.clear()
            self[key] = found
        return found


class ChunkTokenizer:
    """Ids of whole texts, as little-endian 32-bit words, from a memo of space-separated chunks.

    The tokenizer drops white space and never joins tokens across it, so a text's ids are its chunks' ids in order.
    Chunks are cut by the pre-tokenizer - those of printable ASCII and Latin letters by its own pattern - and their parts go
    to the BPE model; chunks that may hold a special token's string go through the whole tokenizer.
    """

    # Fixed value: the pre-tokenizer's pattern for ASCII text, lower-cased; other letters are put in for {0}.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z{0}]+|[0-9]|[^\sa-z0-9{0}]+"
    PART = re.compile(PATTERN.format(""))

    def __init__(self, path: str, room: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.normal, self.cut = self.whole.model, self.whole.normalizer, self.whole.pre_tokenizer
        self.chunks, self.parts = _Memo(self._chunk, room), _Memo(self._part, room)
        letters = [c for c in map(chr, range(0x80, 0x250)) if self._plain(c)]
        small = sorted({c.lower() for c in letters})
        self.latin, self.part = re.compile(f"[!-~{''.join(letters)}]+").fullmatch, re.compile(self.PATTERN.format("".join(small)))
        self.coded = {ord(c): self._cut(c)[0] for c in small}

    def _cut(self, text: str) -> list[str]:
        return [p for p, _ in self.cut.pre_tokenize_str(text)]

    def _plain(self, c: str) -> bool:
        """Whether c is a letter that the tokenizer lower-cases as Python does and codes by itself."""
        low = c.lower()
        return len(low) == 1 and self.normal.normalize_str(f"a{c}a") == f"a{low}a" and self._cut(f"a{low}a") == [f"a{self._cut(low)[0]}a"]

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk:
            return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if chunk.isascii() and chunk.isprintable():
            low = chunk.lower()
            return self.parts[low] if low.isalpha() else b"".join(map(self.parts.__getitem__, self.PART.findall(low)))
        if self.latin(chunk):
            return b"".join([self.parts[p.translate(self.coded)] for p in self.part.findall(chunk.lower())])
        return b"".join(self.parts[p] for p, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(chunk)))

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


_TOKENIZERS: dict[str, ChunkTokenizer] = CACHES.setdefault("packing", {})


def tokenizer_at(path: str | None) -> ChunkTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = path or default_tokenizer()
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""

    def run(batches):
        tok = tokenizer_at(tokenizer)
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["_text"]):
                blob = tok.ids(text) + END
                for k, at in enumerate(range(0, len(blob), 4 * capacity)):
                    part = blob[at : at + 4 * capacity]
                    row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).mapInPandas(tidy(run, "packing"), schema)


# ---- the plan, on the histogram ----


class _Queue:
    """Documents of some lengths, handed out in descending length as (length, first rank, count)."""

    def __init__(self, items: list[tuple[int, int]], used: dict[int, int]):
        self.items, self.used = [list(x) for x in items], used

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            length, left = self.items[0]
            k = min(n, left)
            out.append((length, self.used.get(length, 0), k))
            self.used[length] = self.used.get(length, 0) + k
            n -= k
            if k == left:
                self.items.pop(0)
            else:
                self.items[0][1] -= k
        return out


def _groups(large: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """Linear grouping: descending (length, count) pairs cut into n runs of equal cardinality."""
    total = sum(c for _, c in large)
    out, each = [], max(1, math.ceil(total / n))
    room = 0
    for length, count in large:
        while count:
            if not room:
                out.append([])
                room = each
            k = min(room, count)
            out[-1].append((length, k))
            room -= k
            count -= k
    return out


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size index: copies}) that use up all counts; sizes descend."""
    left, out = list(counts), []
    for top in range(len(sizes)):
        while left[top]:
            room = capacity - sizes[top]
            reach, seen = [1], (1 << (room + 1)) - 1
            for k in range(top, len(sizes)):
                bits, have = reach[-1], left[k] - (k == top)
                for _ in range(min(have, room // sizes[k])):
                    more = (bits | bits << sizes[k]) & seen
                    if more == bits:
                        break
                    bits = more
                reach.append(bits)
            fill = reach[-1].bit_length() - 1
            use = {top: 1}
            for k in range(len(sizes) - 1, top - 1, -1):
                before = reach[k - top]
                while not before >> fill & 1:
                    fill -= sizes[k]
                    use[k] = use.get(k, 0) + 1
            times = min(left[k] // c for k, c in use.items())
            for k, c in use.items():
                left[k] -= times * c
            out.append((times, use))
    return out


def _solve(hist: dict[int, int], capacity: int, n_groups: int, large_share: int) -> list[tuple[int, int, list]]:
    """Segments (bins, room left, [(length, first rank)]) that hold every document once."""
    used: dict[int, int] = {}
    limit = capacity // large_share
    large = [(x, hist[x]) for x in sorted(hist, reverse=True) if limit < x]
    groups = _groups(large, n_groups)
    sizes, members = [], []
    for g in groups:
        if sizes and g[0][0] == sizes[-1]:
            members[-1] += g
        else:
            sizes.append(g[0][0])
            members.append(list(g))
    queues = [_Queue(m, used) for m in members]
    segments = []
    for times, use in _configurations(sizes, [sum(c for _, c in m) for m in members], capacity):
        runs = [queues[k].take(times) for k, copies in sorted(use.items()) for _ in range(copies)]
        cuts = sorted({sum(c for *_, c in r[:i]) for r in runs for i in range(len(r) + 1)})
        for a, b in zip(cuts, cuts[1:]):
            held = []
            for r in runs:
                at = 0
                for length, first, count in r:
                    if at <= a < at + count:
                        held.append((length, first + a - at))
                        break
                    at += count
            segments.append((b - a, capacity - sum(x for x, _ in held), held))
    by_room: dict[int, list] = {}
    rooms: list[int] = []

    def put(bins: int, room: int, held: list) -> None:
        if bins:
            if not by_room.get(room):
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((bins, held))

    for bins, room, held in segments:
        put(bins, room, held)
    for length in sorted((x for x in hist if x <= limit), reverse=True):
        left, rank = hist[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins, held = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                each = min(left, capacity // length)
                bins, room, held = left // each, capacity, []
            each = min(left, room // length)
            full = min(bins, left // each)
            put(bins - full, room, [(x, r + full) for x, r in held])
            put(full, room - each * length, held + [(length, rank + i * full) for i in range(each)])
            left -= full * each
            rank += full * each
    return [(bins, room, held) for room, some in by_room.items() for bins, held in some]


def plan_bins(hist: dict[int, int], capacity: int = CAPACITY) -> tuple[int, dict[int, list[tuple[int, int, int, int]]]]:
    """(bins, {length: [(first rank, count, first sequence, offset)]}) for a histogram of lengths up to capacity."""
    if not hist:
        return 0, {}
    least = math.ceil(sum(x * c for x, c in hist.items()) / capacity)
    best = None
    for n_groups, share in ((64, 6), (32, 4), (256, 8), (128, 4), (capacity, 16), (capacity, 4), (capacity, 2)):
        found = _solve(hist, capacity, n_groups, share)
        n = sum(b for b, _, _ in found)
        if best is None or n < best[0]:
            best = (n, found)
        if n <= least:
            break
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for bins, _, held in best[1]:
        offset = 0
        for length, first in held:
            runs.setdefault(length, []).append((first, bins, base, offset))
            offset += length
        base += bins
    return best[0], {k: sorted(v) for k, v in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be a table that reads the same each time (see Scratch)."""
    spark = pieces.sparkSession
    count = pieces.count()
    buckets = max(1, math.ceil(math.sqrt(count)))
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    dealt = pieces.withColumn("_bucket", key)
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    _, runs = plan_bins(hist, capacity)
    held = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in runs.items()})
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("_place", place).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_place")).drop("_bucket", "_before", "_place")
    names = [c for c in ranked.columns if c != "_rank"]

    def assign(batches):
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b["_rank"].to_numpy(np.int64)
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                first, _, base, offset = held.value[int(x)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                seq[rows], off[rows] = base[k] + rank[rows] - first[k], offset[k]
            yield b[names].assign(sequence_id=seq, offset=off)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInPandas(assign, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    return pack(scratch.keep(token_pieces(docs, id_col, text_col, capacity, tokenizer, with_ids), "pieces"), capacity)


def op8_bestfit_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
