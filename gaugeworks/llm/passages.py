"""Substring deduplication: near-duplicate passages by compact windows.

Tokens are hashed five-word shingles; a passage is `words` words, that is t = words - 4 tokens. For each of four hash
functions a text is cut into compact windows: by the Cartesian tree over its tokens' hashes, every passage belongs to the
one window whose least token it shares, so a window stands for all its passages and their common signature.

0. What can't have a partner stays out: one exchange of 34 bits or so of each token, once a chunk, tells the places whose
   token another document has; a passage goes on if all but few of its places recur, and only such documents' rows are read again.
1. Interval join inside each document, where its text is: the windows of two functions overlap in a cell, a range of passage
   starts, whose two signatures make a key (all six pairs of functions). Cells of a chunk of documents that share a key
   form a star around the chunk's first document of that key; only that one's cells leave the chunk. So no key, however
   hot, sends more than one document's cells a chunk.
2. One exchange brings the cells of a key together, packed by chunk and bucket: only cells whose key another document has
   are written, each with the first one of its key (stars again, never all pairs). Equal texts meet there too, by their hash.
   Past 512 buckets they are dealt in levels of 512, so that a chunk is never split into ever smaller parts.
3. Pairs of a star are verified on their tokens, in stretches a passage wider than what they share on both sides: two
   passages match at a Jaccard similarity of `similarity` or more.
4. An exact join finds what the stars leave. The same exchange counts the documents of every token, known by 48 bits. Similar passages share
   `need` tokens, so a passage with fewer tokens that other documents have has no partner, and of others the first few tokens
   in one common order, the rare ones first, are keys: two similar passages share one. Passages without a match are compared
   with one document of each key (`rounds` times), then with all that have a key, as are documents of two components, unless
   slack or bitmaps of tokens rule the bound out. Keys of more than `limit` rows are dealt in parts.

So every passage that has a similar one in another document is in a stretch, and documents that similar passages connect have
one class. Pairs of matched passages inside a class may be left out: n_links counts the links found, at most all there are.
A key's pairs are all looked at where a passage stays without a match, which grows with the square of such a key.

Result: a row for each maximal matched stretch of each document, with the document's class (smallest id reachable by links)
and its number of links found. Documents without repeated passages have no row.

Defined cases: null and short texts have no passages; rows with null id are left out; ids name documents: rows repeated with
the same id are one document (repeats inside a document don't count); an empty table gives an empty result; other columns
are ignored; ids are cast to long.
"""

from __future__ import annotations

import zlib
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, Scratch, documents, whole
from .components import components

SHINGLE = 5
FUNCTIONS = 4
SHARED = 2
K = np.uint64(0x9E3779B97F4A7C15)
#: Text bytes a bucket of the exchange, and tokens a chunk: what a Python worker holds at once.
BUCKET = 2_000_000
CHUNK = 1 << 20
#: Bits of a token's hash that the exchange leaves out, as most of what it moves are these hashes: 48 are left.
TRIM = np.uint64(16)
#: Most parts that a chunk is split into at once; more buckets than that take another exchange.
FAN = 512


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers, modulo 2 ** 64; kept for texts of usual size."""
    found = _POWERS.get(base)
    if found is None or len(found) < n:
        found = np.cumprod(np.append(np.uint64(1), np.full(max(n, 1 << 16) - 1, base, np.uint64)))
        if n <= 1 << 21:
            _POWERS[base] = found
    return found[:n]


_POWERS: dict[int, np.ndarray] = CACHES.setdefault("passages", {})
#: Odd bases have inverses among 64-bit numbers, so running sums give the hash of any stretch.
BASES = (0x100000001B3, 0x9E3779B97F4A7C15)
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


class Tokens:
    """Hashes of texts' five-word shingles; words as in the fingerprints of simhash.py."""

    @staticmethod
    def of(text: str | None) -> np.ndarray:
        return Tokens.many([text])[0]

    @staticmethod
    def many(texts, share: int = 1 << 20) -> list[np.ndarray]:
        out, held, size = [], [], 0
        for text in texts:
            held.append((text or "").encode("utf-8", "surrogatepass").lower())
            size += len(held[-1])
            if size >= share:
                out += Tokens._of(held)
                held, size = [], 0
        return out + Tokens._of(held) if held else out

    @staticmethod
    def _of(raws: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
        gap = SPACE[raw]
        turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        start, stop = turn[::2], turn[1::2]
        sums = np.cumsum((raw + np.uint64(1)) * _powers(BASES[0], len(raw)))
        w = _mix((sums[stop - 1] - sums[start - 1]) * _powers(pow(BASES[0], -1, 1 << 64), len(raw))[start] + (stop - start).astype(np.uint64))
        n = max(len(w) - SHINGLE + 1, 0)
        out = w[:n].copy()
        for k in range(1, SHINGLE):
            out = out * K + w[k : k + n]
        out = _mix(out)
        # A text's shingles start at its first word and end four words before the next text's first.
        edge = np.searchsorted(start, np.cumsum([1] + [len(r) + 1 for r in raws]))
        return [out[a : max(a, b - SHINGLE + 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def _reversed_bits(x: np.ndarray, bits: int) -> np.ndarray:
    """The lowest `bits` bits of each number in reverse order; higher ones are left out."""
    x = x << np.uint64(64 - bits)
    for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = ((x >> np.uint64(width)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(width))
    return x.byteswap()


def compact_windows(tokens: np.ndarray, starts: np.ndarray, stops: np.ndarray, t: int):
    """For each function: (function, signature, text, first start, last start) of windows that hold a passage of t tokens.

    All texts at once, by levels of their Cartesian trees. Of equal least tokens, the place with the least reversed
    bits is the root, which keeps trees of repetitive texts shallow and doesn't change signatures.
    """
    bits = max(1, int(len(tokens)).bit_length())
    mask = np.uint64((1 << bits) - 1)
    place = np.arange(len(tokens) + 1, dtype=np.uint64)
    low = _reversed_bits(place, bits)
    text = np.arange(len(starts))
    out = []
    for j in range(FUNCTIONS):
        value = _mix(tokens + np.uint64((j + 1) * 0xD6E8FEB86659FD93 % 2**64))
        key = np.append((value & ~mask), ~mask) | low
        lo, hi, own = starts, stops, text
        while True:
            keep = hi - lo >= t
            lo, hi, own = lo[keep], hi[keep], own[keep]
            if not len(lo):
                break
            least = np.minimum.reduceat(key, np.stack([lo, hi], 1).ravel())[::2]
            c = _reversed_bits(least & mask, bits).astype(np.int64)
            out.append((np.full(len(c), j), value[c], own, np.maximum(lo, c - t + 1) - starts[own], np.minimum(c, hi - t) - starts[own]))
            lo, hi, own = np.stack([lo, c + 1], 1).ravel(), np.stack([c, hi], 1).ravel(), np.repeat(own, 2)
    if not out:
        return [np.zeros(0, d) for d in (np.int64, np.uint64, np.int64, np.int64, np.int64)]
    return [np.concatenate(x) for x in zip(*out)]


def cells_of(tokens: np.ndarray, sizes: np.ndarray, t: int):
    """(key, text, first start, last start) of every cell of texts of t tokens or more, given one after the other."""
    stops = np.cumsum(sizes)
    j, v, own, a, _ = compact_windows(tokens, stops - sizes, stops, t)
    starts = sizes - t + 1  # passages of each text; windows of a function cover each of them once
    base = np.cumsum(starts) - starts
    total = int(starts.sum())
    parts = []
    for f in range(FUNCTIONS):
        mine = np.flatnonzero(j == f)
        at = a[mine] + base[own[mine]]
        mark = np.zeros(total, bool)
        mark[at] = True
        rank = np.cumsum(mark, dtype=np.int32) - 1  # the window of each passage
        sig = np.empty(len(mine), np.uint64)
        sig[rank[at]] = v[mine]
        parts.append((mark, rank, sig))
    of = np.repeat(np.arange(len(starts), dtype=np.int32), starts)
    out = []
    for slot, few in enumerate(combinations(range(FUNCTIONS), SHARED)):
        edge = np.flatnonzero(np.logical_or.reduce([parts[f][0] for f in few]))
        key = np.full(len(edge), sum(1 << f for f in few), np.uint64)
        for f in few:
            _, rank, sig = parts[f]
            key = _mix(key * K + sig[rank[edge]])
        key = key & ~np.uint64(7) | np.uint64(slot)  # the pair of functions stays known
        text = of[edge]
        out.append((key, text, edge - base[text], np.append(edge[1:], total) - 1 - base[text]))
    return [np.concatenate(x) for x in zip(*out)]


# Rows of the exchange are columns of numbers, packed: kinds 0 cells, 2 texts and 4 tokens meet in their bucket, 1 and 3 are
# stars of a chunk that only pass through (member cells and copies).
CELLS, MEMBERS, TEXTS, COPIES, TOKENS = range(5)
#: Rows that a chunk sends to itself before that: its documents, places of tokens that two of them have, and of a document's repeats.
DOCS, KNOWN, AGAIN = range(5, 8)
MEMBER = "kind int, key long, doc long, a int, b int, other long, ha int, hb int"


def _pack(*cols: np.ndarray) -> bytes:
    """Columns of longs, the first as it is, in as many bytes as the largest needs, others as byte planes of their differences."""
    first = np.ascontiguousarray(cols[0], "<i8")
    width = 8 if not len(first) or first.min() < 0 else max(1, (int(first.max()).bit_length() + 7) // 8)
    out = [first.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()]
    for c in cols[1:]:
        d = np.diff(c.astype("<i8"), prepend=0)
        z = ((d << 1) ^ (d >> 63)).astype("<u8")
        planes = (int(z.max(initial=0)).bit_length() + 7) // 8
        out.append(zlib.compress(z.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes(), 1) if planes else b"")
    sizes = np.array([len(cols[0])] + [len(x) for x in out], "<u4").tobytes()
    return len(cols).to_bytes(1, "little") + sizes + b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    k = blob[0]
    n, *sizes = np.frombuffer(blob, "<u4", k + 1, 1).tolist()
    at = 1 + 4 * (k + 1)
    first = np.zeros((n, 8), np.uint8)
    if n:
        first[:, : sizes[0] // n] = np.frombuffer(blob, np.uint8, sizes[0], at).reshape(n, -1)
    out = [first.view("<i8").ravel()]
    at += sizes[0]
    for size in sizes[1:]:
        z = np.zeros((n, 8), np.uint8)
        if size:
            planes = np.frombuffer(zlib.decompress(blob[at : at + size]), np.uint8).reshape(-1, n)
            z[:, : len(planes)] = planes.T
        z = z.view("<u8").ravel()
        out.append(np.cumsum((z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64)))
        at += size
    return out


def _star(key: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Rows sorted by key -> for each row: its key's first document, that one's first and last place, whether two or more documents have the key."""
    new = np.append(True, key[1:] != key[:-1])
    edge = np.flatnonzero(new)
    g = np.cumsum(new) - 1
    head = np.minimum.reduceat(doc, edge)
    first = head[g]
    own = doc == first
    ha = np.minimum.reduceat(np.where(own, a, np.iinfo(np.int64).max), edge)[g]
    hb = np.maximum.reduceat(np.where(own, b, -1), edge)[g]
    return first, ha, hb, (np.maximum.reduceat(doc, edge) != head)[g]


def _cell_blobs(t: int, buckets: int, width: int = 1, share: int = CHUNK):
    def chunk(held, salt):
        doc = np.array([d for d, *_ in held], np.int64)
        size = np.array([len(x) for _, x, *_ in held])
        # Equal texts: only the chunk's first one's cells go on.
        h = np.array([_text_hash(x) for _, x, *_ in held], np.uint64).reshape(-1, 2)
        order = np.lexsort((doc, h[:, 1], h[:, 0]))
        same = np.append(False, (h[order][1:] == h[order][:-1]).all(1))
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        other = np.empty(len(doc), np.int64)
        other[order] = doc[head]
        fresh = np.ones(len(doc), bool)
        fresh[order[same]] = False
        lost = np.flatnonzero(~fresh & (other != doc))
        if len(lost):
            yield salt % buckets // width, COPIES, _pack(h[lost, 0].view(np.int64), doc[lost], size[lost], other[lost])
        first = np.flatnonzero(fresh)
        yield from _by_bucket(buckets, width, TEXTS, h[first, 0].view(np.int64), doc[first], size[first], h[first, 1].view(np.int64))
        x, n = np.concatenate([held[i][1] for i in first]), size[first]
        on, live = (np.concatenate([held[i][c] for i in first]) for c in (2, 3))
        some = [(x >> TRIM).view(np.int64), np.repeat(doc[first], n), np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n), np.repeat(n, n), slack(x, n, t)]
        yield from _by_bucket(buckets, width, TOKENS, *(c[on] for c in some))
        key, text, a, b = cells_of(x, n, t)
        # Only cells of a passage that may have a similar one.
        base, before = np.cumsum(n - t + 1) - (n - t + 1), np.append(0, np.cumsum(live))
        some = before[base[text] + b + 1] > before[base[text] + a]
        key, text, a, b = key[some], text[some], a[some], b[some]
        key, own = key.view(np.int64), doc[first][text]
        order = np.argsort(key)
        # Most keys are alone: stars are made of the others.
        again = np.append(key[order][1:] == key[order][:-1], False)
        again[1:] |= again[:-1]
        order = order[again]
        mine, many = np.ones(len(key), bool), np.zeros(len(key), np.int64)
        if len(order):
            k, d, x, y = key[order], own[order], a[order], b[order]
            head, ha, hb, more = _star(k, d, x, y)
            mine[order], many[order] = d == head, more
            at = np.flatnonzero(d != head)
            if len(at):
                yield salt % buckets // width, MEMBERS, _pack(k[at], d[at], x[at], y[at], head[at], ha[at], hb[at])
        at = np.flatnonzero(mine)
        yield from _by_bucket(buckets, width, CELLS, key[at], own[at], a[at], b[at], many[at])

    def run(batches):
        frame = lambda held, salt: pd.DataFrame(list(chunk(held, salt)), columns=["bucket", "kind", "cols"])
        held, size = [], 0
        for batch in batches:
            bits = zip(batch["on"], batch["live"]) if "on" in batch else repeat((None, None))
            for doc, x, some in zip(batch["doc"], Tokens.many(batch["_text"]), bits):
                if len(x) >= t:
                    held.append((doc, x, *(np.ones(n, bool) if b is None else np.unpackbits(np.frombuffer(b, np.uint8), count=n).view(bool) for b, n in zip(some, (len(x), len(x) - t + 1)))))
                    size += len(x)
                if size >= share:
                    yield frame(held, zlib.crc32(b"%d" % held[0][0]))
                    held, size = [], 0
        if held:
            yield frame(held, zlib.crc32(b"%d" % held[0][0]))

    return run


def slack(tokens: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """For each place, the most that a passage over it has fewer distinct tokens than t; texts one after the other."""
    out = np.zeros(len(tokens), np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.argsort(tokens, kind="stable")
    again = (tokens[at][1:] == tokens[at][:-1]) & (text[at][1:] == text[at][:-1]) & (np.diff(at) < t)
    stop = np.cumsum(sizes)
    for i in np.unique(text[at[1:][again]]).tolist():
        x = tokens[stop[i] - sizes[i] : stop[i]]
        n = len(x) - t + 1
        _, first, last = _spans(x, t)
        few = np.pad(t - _distinct(first, last, n), t - 1)
        out[stop[i] - sizes[i] : stop[i]] = np.lib.stride_tricks.sliding_window_view(few, t).max(1)
    return out


def _text_hash(x: np.ndarray) -> tuple[int, int]:
    import xxhash

    raw = x.tobytes()
    return xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)


def _by_bucket(buckets: int, width: int, kind: int, key: np.ndarray, *cols: np.ndarray):
    """Packed rows of each group of `width` buckets; the order of rows stays."""
    bucket = (key.view(np.uint64) >> np.uint64(3)) % np.uint64(buckets) // np.uint64(width)
    if buckets < 1 << 16:
        bucket = bucket.astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(rows):
            yield int(bucket[rows[0]]), kind, _pack(key[rows], *[c[rows] for c in cols])


BLOB = "bucket long, kind int, cols binary"


def _widths(buckets: int, fan: int) -> list[int]:
    """Buckets a group at each exchange: no step splits anything into more than about `fan` parts."""
    out = [1]
    while -(-buckets // out[-1]) > fan:
        out.append(out[-1] * fan)
    return out[::-1]


def _refine(buckets: int, width: int, fan: int, share: int = CHUNK, deal=_by_bucket):
    """Packed rows by groups of width x fan buckets, sorted by group -> by groups of width."""

    def split(held):
        for kind in (CELLS, TEXTS, TOKENS):
            some = [cols for k, cols in held if k == kind]
            if some:
                yield from deal(buckets, width, kind, *(np.concatenate(x) for x in zip(*some)))

    def run(batches):
        frame = lambda rows: pd.DataFrame(rows, columns=["bucket", "kind", "cols"])
        group, held, size = None, [], 0
        for batch in batches:
            for at, kind, blob in zip(batch["bucket"], batch["kind"], batch["cols"]):
                if kind not in (CELLS, TEXTS, TOKENS):
                    yield frame([(at * fan + zlib.crc32(blob) % fan, kind, blob)])
                    continue
                if held and (at != group or size >= share):
                    yield frame(list(split(held)))
                    held, size = [], 0
                group = at
                held.append((kind, _unpack(bytes(blob))))
                size += len(held[-1][1][0])
        if held:
            yield frame(list(split(held)))

    return run


# ---- documents that may have a similar passage in another one ----


def _by_range(bits: int):
    def deal(buckets: int, width: int, kind: int, place: np.ndarray, key: np.ndarray, chunk: np.ndarray):
        """As _by_bucket, with a range of keys of so many bits a bucket: differences of sorted ones are small."""
        bucket = (key * buckets >> bits) // width
        if buckets < 1 << 16:
            bucket = bucket.astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(rows):
                yield int(bucket[rows[0]]), kind, _pack(place[rows], key[rows], chunk[rows])

    return deal


def _key_blobs(t: int, buckets: int, width: int, bits: int, share: int = CHUNK):
    """(doc, _text, text) -> a chunk's tokens, each once, by `bits` bits of its hash, and what only the chunk's own rows need.

    A token of one document has its first place (from 1); one of two or more is known to recur: it has place 0.
    """

    def chunk(held):
        doc, text = (np.array([h[c] for h in held], np.int64) for c in (0, 1))
        size = np.array([len(x) for _, _, x in held])
        key = (np.concatenate([x for _, _, x in held]) >> np.uint64(64 - bits)).view(np.int64)
        name = _text_hash(np.concatenate([doc, text, size]))[0] >> 1
        own = np.repeat(np.arange(len(doc)), size)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        edge, g = np.flatnonzero(new), np.cumsum(new) - 1
        many = own[order[edge]] != own[order[np.append(edge[1:], len(key)) - 1]]
        back = ~new & ~many[g]
        known, again = order[many[g]], np.stack([order[back], order[edge][g[back]]])
        known.sort()
        again = again[:, np.argsort(again[0])]
        for kind, cols in ((DOCS, (doc, text, size)), (KNOWN, (known,)), (AGAIN, again)):
            blob = name.to_bytes(8, "little") + _pack(np.zeros(len(cols[0]), np.int64), *cols)
            yield name % buckets // width, kind, blob
        yield from _by_range(bits)(buckets, width, TOKENS, np.where(many, 0, order[edge] + 1), key[edge], np.full(len(edge), name))

    def run(batches):
        frame = lambda held: pd.DataFrame(list(chunk(held)), columns=["bucket", "kind", "cols"])
        held, size = [], 0
        for batch in batches:
            for doc, text, x in zip(batch["doc"], batch["text"], Tokens.many(batch["_text"])):
                if len(x) >= t:
                    held.append((doc, text, x))
                    size += len(x)
                if size >= share:
                    yield frame(held)
                    held, size = [], 0
        if held:
            yield frame(held)

    return run


PLACES = "chunk long, kind int, cols binary"


def _recurring(share: int = CHUNK):
    """Tokens by bucket -> places, by chunk, of those that another chunk has too."""

    def solve(held):
        place, key, chunk = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        again = np.append(key[order][1:] == key[order][:-1], False)
        again[1:] |= again[:-1]
        order = order[again]
        order = order[place[order] > 0]
        return chunk[order], place[order] - 1

    def send(found):
        chunk, place = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, chunk))
        chunk, place = chunk[order], place[order]
        for rows in np.split(np.arange(len(chunk)), np.flatnonzero(np.diff(chunk)) + 1):
            if len(rows):
                yield int(chunk[rows[0]]), KNOWN, _pack(np.zeros(len(rows), np.int64), place[rows])

    def run(batches):
        frame = lambda rows: pd.DataFrame(rows, columns=["chunk", "kind", "cols"])
        bucket, held, found, size = None, [], [], 0
        for batch in batches:
            for at, kind, blob in zip(batch["bucket"], batch["kind"], batch["cols"]):
                if kind != TOKENS:
                    yield frame([(int.from_bytes(blob[:8], "little"), kind, bytes(blob[8:]))])
                    continue
                if held and at != bucket:
                    found.append(solve(held))
                    held, size = [], size + len(found[-1][0])
                    if size >= share:
                        yield frame(list(send(found)))
                        found, size = [], 0
                bucket = at
                held.append(_unpack(bytes(blob)))
        if held:
            found.append(solve(held))
        if found:
            yield frame(list(send(found)))

    return run


LIVE = "doc long, text long, on binary, live binary"


def _live(t: int, similarity: float):
    """Rows of chunks, sorted by chunk -> documents with a passage that may have a similar one: bits of its recurring tokens and of such passages' starts.

    Of the distinct tokens of such a passage at most t - full are in no other document, so at least `full` places recur or repeat.
    """
    full = int(np.ceil(similarity * t - 1e-9))

    def chunk(held):
        doc, text, size = next(cols for kind, cols in held if kind == DOCS)
        on = np.zeros(int(size.sum()), bool)
        for kind, cols in held:
            if kind == KNOWN:
                on[cols[0]] = True
        place, first = next(cols for kind, cols in held if kind == AGAIN)
        on[place] = on[first]
        fit = on.copy()
        fit[place] = True
        before = np.append(0, np.cumsum(fit))
        for d, h, stop, n in zip(doc.tolist(), text.tolist(), np.cumsum(size).tolist(), size.tolist()):
            s = stop - n
            live = before[s + t : stop + 1] - before[s : stop - t + 1] >= full
            if live.any():
                near = np.cumsum(np.bincount(np.flatnonzero(live), minlength=n + 1) - np.bincount(np.flatnonzero(live) + t, minlength=n + 1))[:n] > 0
                yield d, h, np.packbits(on[s:stop] & near).tobytes(), np.packbits(live).tobytes()

    def run(batches):
        frame = lambda held: pd.DataFrame(list(chunk(held)), columns=["doc", "text", "on", "live"]).astype({"doc": "int64", "text": "int64"})
        name, held = None, []
        for batch in batches:
            for at, kind, blob in zip(batch["chunk"], batch["kind"], batch["cols"]):
                if held and at != name:
                    yield frame(held)
                    held = []
                name = at
                held.append((kind, _unpack(bytes(blob))[1:]))
        if held:
            yield frame(held)

    return run


def candidates(rows: DataFrame, t: int, similarity: float, scratch: Scratch, bucket: int, fan: int) -> DataFrame:
    """The rows (doc, _text) that may have a similar passage in another one, with bits as in _live.

    What two chunks share is known from a part of each token's hash, which is in the exchange once a chunk: tokens that only
    seem to recur, about one in 500, keep some rows more and lose none.
    """
    size = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    buckets, bits = 1 + size // (4 * bucket), min(44, (size // 4).bit_length() + 8)
    widths = _widths(buckets, fan)
    dealt = lambda blobs: blobs.repartition("bucket").sortWithinPartitions("bucket")
    named = rows.withColumn("text", F.xxhash64("_text"))
    blobs = named.mapInPandas(_key_blobs(t, buckets, widths[0], bits), BLOB)
    for width in widths[1:]:
        blobs = dealt(blobs).mapInPandas(_refine(buckets, width, fan, deal=_by_range(bits)), BLOB)
    places = dealt(blobs).mapInPandas(_recurring(), PLACES)
    live = scratch.keep(places.repartition("chunk").sortWithinPartitions("chunk").mapInPandas(_live(t, similarity), LIVE), "live")
    return scratch.keep(named.join(live.dropDuplicates(["doc", "text"]), ["doc", "text"]).drop("text"), "candidates")


def _meet(batches):
    """Packed rows, sorted by bucket -> members (kind 0: cells of keys that other documents have too), copies (kind 1) and recurring tokens (kind 2).

    A token's row has its place, its document's size, the number of documents that have it, and the most slack among them.
    Holds one bucket at a time: its size is bounded, as a chunk sends no more than one document's cells of a key.
    """

    def rows(kind, key, doc, a, b, other, ha, hb):
        return pd.DataFrame({"kind": np.full(len(key), kind, np.int32), "key": key, "doc": doc, "a": a.astype(np.int32), "b": b.astype(np.int32), "other": pd.array(other, "Int64"), "ha": ha.astype(np.int32), "hb": hb.astype(np.int32)})

    def meet(held):
        for kind, cols in held:
            if kind == MEMBERS:
                yield rows(0, *cols)
            elif kind == COPIES:
                yield rows(1, cols[0], cols[1], cols[2], cols[2] * 0, cols[3], cols[2] * 0, cols[2] * 0)
        texts = [cols for kind, cols in held if kind == TEXTS]
        if texts:
            key, doc, size, more = (np.concatenate(x) for x in zip(*texts))
            order = np.lexsort((doc, more, key))
            key, doc, size, more = key[order], doc[order], size[order], more[order]
            new = np.append(True, (key[1:] != key[:-1]) | (more[1:] != more[:-1]))
            other = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            at = np.flatnonzero(other != doc)
            if len(at):
                yield rows(1, key[at], doc[at], size[at], size[at] * 0, other[at], size[at] * 0, size[at] * 0)
        tokens = [cols for kind, cols in held if kind == TOKENS]
        if tokens:
            key, doc, at, size, few = (np.concatenate(x) for x in zip(*tokens))
            order = np.argsort(key)
            again = np.append(key[order][1:] == key[order][:-1], False)
            again[1:] |= again[:-1]
            order = order[again]
            order = order[np.lexsort((doc[order], key[order]))]
            if len(order):
                key, doc, at, size, few = (x[order] for x in (key, doc, at, size, few))
                new = np.append(True, key[1:] != key[:-1])
                edge = np.flatnonzero(new)
                of = np.cumsum(new) - 1
                fresh = new | np.append(True, doc[1:] != doc[:-1])
                yield rows(2, key, doc, at, size, np.add.reduceat(fresh, edge, dtype=np.int64)[of], np.maximum.reduceat(few, edge)[of], at * 0)
        cells = [cols for kind, cols in held if kind == CELLS]
        if cells:
            key, doc, a, b, known = (np.concatenate(x) for x in zip(*cells))
            order = np.argsort(key)
            # Most keys are alone: neither met here nor in their chunk.
            again = np.append(key[order][1:] == key[order][:-1], False)
            again[1:] |= again[:-1]
            order = order[again | (known[order] > 0)]
            if not len(order):
                return
            key, doc, a, b, known = (x[order] for x in (key, doc, a, b, known))
            head, ha, hb, many = _star(key, doc, a, b)
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            shared = np.repeat(np.maximum.reduceat(known, edge) > 0, np.diff(np.append(edge, len(key)))) | many
            at = np.flatnonzero(shared)
            if len(at):
                found = rows(0, key[at], doc[at], a[at], b[at], head[at], ha[at], hb[at])
                found.loc[doc[at] == head[at], "other"] = pd.NA
                yield found

    bucket, held = None, []
    for batch in batches:
        for at, kind, blob in zip(batch["bucket"], batch["kind"], batch["cols"]):
            if at != bucket:
                yield from meet(held)
                bucket, held = at, []
            held.append((kind, _unpack(bytes(blob))))
    yield from meet(held)


def _spans(tokens: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, first, last): for each distinct token the disjoint ranges of starts whose passages hold it, sorted by token."""
    n = len(tokens) - t + 1
    at = np.argsort(tokens, kind="stable")
    v = tokens[at]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (at[1:] - at[:-1] > t)
    edge = np.flatnonzero(new)
    return v[edge], np.maximum(at[edge] - t + 1, 0), np.minimum(at[np.append(edge[1:], len(v)) - 1], n - 1)


def _distinct(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Distinct tokens of each start's passage."""
    return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1))[:n]


def _runs(on: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the stretches that are on."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    return [(int(a), int(e - a)) for a, e in zip(edge[::2], edge[1::2])]


def match(x: np.ndarray, y: np.ndarray, t: int, similarity: float, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each start in x, and each in y, whether its passage has a similar enough one in the other.

    Exact for all pairs of starts. A token is in the passages of a range of starts in x and a range in y, so it adds one to
    the intersection on a rectangle of pairs; rectangles are summed by differences, tile by tile, and tiles that too few
    of them touch are left out.
    """
    n, m = len(x) - t + 1, len(y) - t + 1
    good, also = np.zeros(max(n, 0), bool), np.zeros(max(m, 0), bool)
    if n <= 0 or m <= 0:
        return good, also
    (vx, xa, xe), (vy, ya, ye) = _spans(x, t), _spans(y, t)
    dx, dy = _distinct(xa, xe, n), _distinct(ya, ye, m)
    # both >= similarity * (dx + dy - both), solved for both.
    part = similarity / (1 + similarity)
    px, py = part * dx - 1e-9, part * dy
    lo, hi = np.searchsorted(vy, vx, "left"), np.searchsorted(vy, vx, "right")
    # A passage that shares less than `similarity` of its own tokens with all of the other text has no partner: only the
    # range of starts between the first and last that may have one is compared.
    held = np.bincount(np.concatenate([lo, hi]), weights=np.concatenate([np.ones(len(lo)), -np.ones(len(hi))]), minlength=len(vy) + 1).cumsum()[: len(vy)] > 0
    ways = np.flatnonzero(_distinct(xa[hi > lo], xe[hi > lo], n) >= similarity * dx - 1e-9)
    back = np.flatnonzero(_distinct(ya[held], ye[held], m) >= similarity * dy - 1e-9)
    if not len(ways) or not len(back):
        return good, also
    r0, c0 = int(ways[0]), int(back[0])
    good_, also_, n, m = good[r0 : ways[-1] + 1], also[c0 : back[-1] + 1], int(ways[-1]) + 1 - r0, int(back[-1]) + 1 - c0
    px, py, dx = px[r0 : r0 + n], py[c0 : c0 + m], dx[r0 : r0 + n]
    some = (xa < r0 + n) & (xe >= r0) & (hi > lo)
    xa, xe, lo, hi = np.maximum(xa[some] - r0, 0), np.minimum(xe[some] - r0, n - 1), lo[some], hi[some]
    inside = (ya < c0 + m) & (ye >= c0)
    kept = np.append(0, np.cumsum(inside))
    lo, hi = kept[lo], kept[hi]
    ya, ye = np.maximum(ya[inside] - c0, 0), np.minimum(ye[inside] - c0, m - 1)
    for r in range(0, n, tile):
        rows = min(tile, n - r)
        some = np.flatnonzero((xa < r + rows) & (xe >= r) & (hi > lo))
        k = hi[some] - lo[some]
        i = np.repeat(some, k)
        j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[some], k)
        # Rectangles by the column tiles they touch.
        c0, c1 = ya[j] // tile, ye[j] // tile
        w = c1 - c0 + 1
        at = np.repeat(np.arange(len(j)), w)
        c = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(c0, w)
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        cut = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c)) if len(c) else [0]
        least = similarity * dx[r : r + rows].min() - 1e-9
        for p, q in zip(cut[:-1], cut[1:]):
            if q - p < least:
                continue
            left = int(c[p]) * tile
            cols = min(tile, m - left)
            f, g = i[at[p:q]], j[at[p:q]]
            a, e = np.maximum(xa[f] - r, 0), np.minimum(xe[f] - r, rows - 1) + 1
            b, h = np.maximum(ya[g] - left, 0), np.minimum(ye[g] - left, cols - 1) + 1
            wide, size = cols + 1, (rows + 1) * (cols + 1)
            both = np.bincount(np.concatenate([a * wide + b, e * wide + h]), minlength=size) - np.bincount(np.concatenate([a * wide + h, e * wide + b]), minlength=size)
            both = both.astype(np.int32).reshape(rows + 1, wide).cumsum(0, dtype=np.int32).cumsum(1, dtype=np.int32)[:rows, :cols]
            hit = both >= px[r : r + rows, None] + py[None, left : left + cols]
            good_[r : r + rows] |= hit.any(1)
            also_[left : left + cols] |= hit.any(0)
    return good, also


def _sides(t: int):
    """(doc, u, v, side, a, b, _text) -> the tokens of the stretch of starts a to b, widened by a passage on both sides."""

    def run(batches):
        last, x = None, None
        for batch in batches:
            out = []
            for doc, u, v, side, a, b, text in zip(*(batch[c] for c in ("doc", "u", "v", "side", "a", "b", "_text"))):
                if doc != last:
                    last, x = doc, Tokens.of(text)
                lo = max(0, a - t)
                out.append((u, v, side, lo, x[lo : b + 2 * t].tobytes()))
            yield pd.DataFrame(out, columns=["u", "v", "side", "lo", "x"]).astype({"side": "int32", "lo": "int32"})

    return run


MATCH = "doc long, other long, a int, n int"


def _verify(t: int, similarity: float):
    """Both sides of pairs, sorted -> matched stretches of both documents."""

    def pair(u, v, one, two):
        (lo, x), (ho, y) = one, two
        if len(x) < t or len(y) < t:
            return
        good, also = match(x, y, t, similarity)
        yield from ((u, v, lo + s, n) for s, n in _runs(good))
        yield from ((v, u, ho + s, n) for s, n in _runs(also))

    def run(batches):
        one = None
        for b in batches:
            out = []
            for u, v, side, lo, x in zip(*(b[c] for c in ("u", "v", "side", "lo", "x"))):
                x = np.frombuffer(x, "<u8")
                if side == 0:
                    one = (u, v, lo, x)
                elif one is not None and one[:2] == (u, v):
                    out += pair(u, v, one[2:], (lo, x))
                    one = None  # a repeated row of the same document is not judged again
            yield pd.DataFrame(out, columns=["doc", "other", "a", "n"]).astype({"doc": "int64", "other": "int64", "a": "int32", "n": "int32"})

    return run


def _by_document(batches, share: int = 1 << 16):
    """Hands on all rows of one or more whole documents at a time, about `share` rows; input is sorted by doc."""
    held, size = [], 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        size += len(b)
        if size < share:
            continue
        b = pd.concat(held, ignore_index=True)
        doc = b["doc"].to_numpy()
        cut = int(np.searchsorted(doc, doc[-1]))
        # A document of more rows is gathered until it has twice as many, not again with each batch.
        held, size = [b.iloc[cut:]], 0 if cut else -len(b)
        if cut:
            yield b.iloc[:cut]
    if held:
        yield pd.concat(held, ignore_index=True)


PAIR = "doc long, other long, a int, b int, ha int, hb int"


def _grouped(batches):
    """Rows (doc, other, a, b, ha, hb), sorted by doc and other -> one row a pair, from the first to the last place."""

    def pairs(x):
        doc, other, a, b, ha, hb = x.T
        new = np.append(True, (x[1:, :2] != x[:-1, :2]).any(1))
        edge = np.flatnonzero(new)
        return pd.DataFrame(
            {"doc": doc[edge], "other": other[edge], "a": np.minimum.reduceat(a, edge), "b": np.maximum.reduceat(b, edge), "ha": np.minimum.reduceat(ha, edge),
             "hb": np.maximum.reduceat(hb, edge)}
        ).astype({c: "int32" for c in ("a", "b", "ha", "hb")})

    held = np.zeros((0, 6), np.int64)
    for batch in batches:
        x = np.concatenate([held, batch.to_numpy(np.int64)])
        if not len(x):
            continue
        x = x[np.lexsort(x.T[::-1])]
        x = x[np.append(True, (x[1:] != x[:-1]).any(1))]
        cut = int(np.argmax((x[:, :2] == x[-1, :2]).all(1)))
        held = x[cut:]
        if cut:
            yield pairs(x[:cut])
    if len(held):
        yield pairs(held)


def _pairs(stars: DataFrame) -> DataFrame:
    """One row a pair of documents, with the stretches from their first to their last shared place."""
    rows = stars.select("doc", "other", "a", "b", "ha", "hb")
    return rows.repartition("doc", "other").sortWithinPartitions("doc", "other").mapInPandas(_grouped, PAIR)


def _judge(pairs: DataFrame, rows: DataFrame, t: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(doc, other, a, n): matched stretches of the pairs, both ways; pairs is a written table."""
    sides = pairs.select("doc", F.col("doc").alias("u"), F.col("other").alias("v"), F.lit(0).alias("side"), "a", "b").unionByName(
        pairs.select(F.col("other").alias("doc"), F.col("doc").alias("u"), F.col("other").alias("v"), F.lit(1).alias("side"), F.col("ha").alias("a"), F.col("hb").alias("b"))
    )
    # Written first: a hub's rows can then be split between tasks of the join.
    texts = scratch.keep(sides, "sides").join(rows, "doc").mapInPandas(_sides(t), "u long, v long, side int, lo int, x binary")
    judged = texts.repartition("u", "v").sortWithinPartitions("u", "v", "side").mapInPandas(_verify(t, similarity), MATCH)
    return scratch.keep(judged, "judged")


PREFIX = "doc long, key long, a int, b int, lack int, least int, open int"
#: No slack at all asks for a key: its starts are all in matched stretches.
NEVER = 1 << 30


def _prefixes(t: int, similarity: float):
    """Recurring tokens (doc, key, a place, b size, other documents, ha slack) and matched stretches (key null, a to b), sorted by doc -> keys of the exact join.

    Similar passages share `need` tokens or more, all of which other documents have; how many depends on the partner's slack,
    the number of distinct tokens it has fewer than t. So a passage with fewer such tokens has no partner, and of two that
    are similar the first s - need + 1 of each one's s such tokens, by (documents, hash), share one. A row is the range of
    starts that a token is a key of: `lack` is their own largest slack, `least` the least slack of a partner that asks for
    the key, `open` the same for starts in no matched stretch.
    """
    part = similarity / (1 + similarity)
    full = int(np.ceil(similarity * t - 1e-9))
    most = t - full + 1

    def keys(doc, key, at, size, many, few, on):
        n = int(size.max())
        starts = n - t + 1
        # The document's own numbers of its tokens, in the common order.
        order = np.lexsort((key, many))
        new = np.append(True, key[order][1:] != key[order][:-1])
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new) - 1
        big = len(key)
        place, lack, prev = np.full(n, big), np.zeros(n, np.int64), np.full(n, -1)
        place[at] = np.where(many > 1, rank, big)
        lack[at] = few
        by = np.lexsort((at, rank))
        same = rank[by][1:] == rank[by][:-1]
        prev[at[by][1:][same]] = at[by][:-1][same]
        code = np.zeros(big, np.int64)
        code[rank] = key
        view = np.lib.stride_tricks.sliding_window_view
        held = np.append(0, np.cumsum(place < big))
        live = np.flatnonzero(held[t:] - held[:starts] >= full)
        out = []
        for i in range(0, len(live), 1 << 13):
            s = live[i : i + (1 << 13)]
            w, d = view(place, t)[s], np.full(len(s), t)
            if same.any():
                again = view(prev, t)[s] >= s[:, None]
                w, d = np.where(again, big, w), t - again.sum(1)
            have = (w < big).sum(1)
            floor = np.ceil(similarity * d - 1e-9).astype(np.int64)
            need = np.maximum(floor, np.ceil(part * (d + t) - 1e-9).astype(np.int64))
            if lack.any():
                # A partner of slack k has at least `need` tokens that occur with this slack.
                slacks = np.where(w < big, view(lack, t)[s], 0)
                for k in np.unique(slacks[slacks > 0]).tolist():
                    asked = np.maximum(floor, np.ceil(part * (d + t - k) - 1e-9).astype(np.int64))
                    need = np.where((slacks >= k).sum(1) >= asked, np.minimum(need, asked), need)
            some = have >= need
            s, w, d, have, need = (x[some] for x in (s, w, d, have, need))
            if len(s):
                coded = w * t + np.arange(t)
                head = np.sort(np.partition(coded, most - 1, 1)[:, :most], 1)
                r, q = np.nonzero(np.arange(most) <= (have - need)[:, None])
                least = np.maximum(0, np.ceil(d[r] + t - (have[r] - q) / part - 1e-6)).astype(np.int64)
                out.append((s[r] + head[r, q] % t, s[r], t - d[r], least))
        if not out:
            return None
        p, s, own, least = (np.concatenate(x) for x in zip(*out))
        by = np.lexsort((s, p))
        p, s, own, least = p[by], s[by], own[by], least[by]
        # Starts without a match are rows of their own.
        edge = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (on[s[1:]] != on[s[:-1]]) | (~on[s[1:]] & (np.diff(s) > 1))))
        return (
            np.full(len(edge), doc), code[place[p[edge]]], s[edge], s[np.append(edge[1:], len(s)) - 1], np.maximum.reduceat(own, edge),
            np.minimum.reduceat(least, edge), np.minimum.reduceat(np.where(on[s], NEVER, least), edge),
        )

    def run(batches):
        for b in _by_document(batches):
            x = b.drop(columns="key").fillna(0).to_numpy(np.int64)
            token, key = b["key"].notna().to_numpy(), b["key"].fillna(0).to_numpy(np.int64)
            col = {c: k for k, c in enumerate(b.columns.drop("key"))}
            doc, a, e = x[:, col["doc"]], x[:, col["a"]], x[:, col["b"]]
            # Only documents with a window in which `full` places have such tokens.
            shared = np.flatnonzero(token & (x[:, col["other"]] > 1))
            shared = shared[np.lexsort((a[shared], doc[shared]))]
            far = shared[full - 1 :]
            near = shared[: len(far)]
            some = np.unique(doc[near[(doc[near] == doc[far]) & (a[far] - a[near] < t)]])
            lo, hi = np.searchsorted(doc, some, "left"), np.searchsorted(doc, some, "right")
            out = []
            for d, p, q in zip(some.tolist(), lo.tolist(), hi.tolist()):
                mine, rest = p + np.flatnonzero(token[p:q]), p + np.flatnonzero(~token[p:q])
                n = int(e[mine].max())
                on = np.cumsum(np.bincount(a[rest], minlength=n + 1) - np.bincount(e[rest] + 1, minlength=n + 1))[:n] > 0
                out.append(keys(d, key[mine], a[mine], e[mine], x[mine, col["other"]], x[mine, col["ha"]], on))
            out = [o for o in out if o is not None]
            if out:
                names = ["doc", "key", "a", "b", "lack", "least", "open"]
                yield pd.DataFrame({c: np.concatenate(x).astype(np.int64 if c in names[:2] else np.int32) for c, x in zip(names, zip(*out))})

    return run


GROUP = ["key", "_a", "_b"]
#: Words of 64 bits in a bitmap.
MARK = 8
MARKED = "doc long, key long, a int, b int, lack int, least int, open int, component long, lone int, core binary, span binary"


def _marks(t: int):
    """Recurring tokens (open null) and rows of keys, sorted by doc -> the rows with bitmaps of their tokens.

    `core` has the tokens that all passages of the row hold, `span` those that any holds; `lone` counts the places of the core
    whose tokens no other document has.
    """

    def maps(bit, lo, hi):
        out = []
        for i in range(0, len(lo), 1 << 12):
            at, n = lo[i : i + (1 << 12)], np.maximum(hi[i : i + (1 << 12)] - lo[i : i + (1 << 12)], 0)
            on = np.zeros((len(n), 64 * MARK), np.uint8)
            on[np.repeat(np.arange(len(n)), n), bit[np.arange(n.sum()) + np.repeat(at - np.cumsum(n) + n, n)]] = 1
            out += [x.tobytes() for x in np.packbits(on, axis=1)]
        return out

    def run(batches):
        for b in _by_document(batches):
            x = b.fillna(-1).to_numpy(np.int64)
            col = {c: k for k, c in enumerate(b.columns)}
            row = b["open"].notna().to_numpy()
            x = x[np.lexsort((x[:, col["a"]], row, x[:, col["doc"]]))]
            row = x[:, col["open"]] >= 0
            doc, key, a, e = (x[:, col[c]] for c in ("doc", "key", "a", "b"))
            out, tok = np.flatnonzero(row), np.flatnonzero(~row & (x[:, col["other"]] > 1))
            wide = int(max(a.max(), e.max())) + t + 2
            base = np.unique(doc, return_inverse=True)[1] * wide
            bit = (_mix(key[tok].view(np.uint64)) & np.uint64(64 * MARK - 1)).astype(np.int64)
            first, c0, c1, last = (np.searchsorted(base[tok] + a[tok], base[out] + p) for p in (a[out], e[out], a[out] + t, e[out] + t))
            core, span = maps(bit, c0, c1), maps(bit, first, last)
            lone = np.where((c1 > c0) | (a[out] + t > e[out]), a[out] + t - e[out] - (c1 - c0), 0)
            names = ["doc", "key", "a", "b", "lack", "least", "open", "component"]
            yield pd.DataFrame({c: x[out, col[c]] for c in names} | {"lone": lone, "core": core, "span": span}).astype({c: "int32" for c in ("a", "b", "lack", "least", "open", "lone")})

    return run


STAR = "doc long, other long, a int, b int, ha int, hb int"


def _candidates(t: int, similarity: float, tile: int = 1 << 16):
    """Rows sorted by GROUP -> the pairs of a group of which one asks for the other: it is open, or they are of two components. Holds one batch, the open group and a tile of pairs."""

    part = similarity / (1 + similarity)

    def solve(b):
        core, span = (np.frombuffer(b"".join(b[c]), np.uint64).reshape(-1, MARK) for c in ("core", "span"))
        lone = b["lone"].to_numpy(np.int64)
        # Repeats are no tokens of their own, and what isn't shared says nothing about them.
        lone = np.where(b["lack"] > 0, 0, lone)
        # Of similar passages each one lacks few of the other one's tokens, more if its partner has slack.
        few = lambda i, j: lone[i] + np.bitwise_count(core[i] & ~span[j]).sum(1, dtype=np.int64) <= t * (1 - 2 * part) + part * lack[j] + 1e-6
        doc, x, e, own, c = (b[k].to_numpy(np.int64) for k in ("doc", "a", "b", "_own", "component"))
        lack, least, open_ = (b[k].to_numpy(np.int64) for k in ("lack", "least", "open"))
        cross = (b["_a"] != b["_b"]).to_numpy()
        k = b[GROUP].to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(1))), len(b))
        later = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(b)) - 1
        done = np.cumsum(later)
        p = 0
        while p < len(b):
            q = max(p + 1, int(np.searchsorted(done, (done[p - 1] if p else 0) + tile, "right")))
            many = later[p:q]
            i = np.repeat(np.arange(p, q), many)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            fit = (lack[i] >= least[j]) & (lack[j] >= least[i]) & ((c[i] != c[j]) | (lack[j] >= open_[i]) | (lack[i] >= open_[j])) & (doc[i] != doc[j]) & ((own[i] != own[j]) | ~cross[i])
            i, j = i[fit], j[fit]
            near = few(i, j)
            i, j = i[near], j[near]
            near = few(j, i)
            i, j = i[near], j[near]
            i, j = np.where(doc[i] > doc[j], i, j), np.where(doc[i] > doc[j], j, i)
            if len(i):
                yield pd.DataFrame({"doc": doc[i], "other": doc[j], "a": x[i], "b": e[i], "ha": x[j], "hb": e[j]}).astype({n: "int32" for n in ("a", "b", "ha", "hb")})
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
            other = np.flatnonzero((b[GROUP].to_numpy() != k[-1]).any(1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from solve(b.iloc[:cut])
            held = [b.iloc[cut:]]
        if held:
            yield from solve(pd.concat(held, ignore_index=True))

    return run


def _keys(tokens: DataFrame, matched: DataFrame, t: int, similarity: float) -> DataFrame:
    level = tokens.unionByName(matched.select("doc", F.lit(None).cast("long").alias("key"), "a", (F.col("a") + F.col("n") - 1).alias("b")).distinct(), allowMissingColumns=True)
    return level.repartition("doc").sortWithinPartitions("doc").mapInPandas(_prefixes(t, similarity), PREFIX)


def _rest(tokens: DataFrame, matched: DataFrame, rows: DataFrame, t: int, similarity: float, scratch: Scratch, rounds: int, limit: int) -> DataFrame:
    """matched (doc, other, a, n) and what the exact join adds: a match for each passage that has one, and the links between components."""
    keys = scratch.keep(_keys(tokens, matched, t, similarity), "prefixes")
    shared = scratch.keep(keys.groupBy("key").agg(F.min("doc").alias("_x"), F.max("doc").alias("_y")).where("_x <> _y").select("key"), "shared")
    keys = scratch.keep(keys.join(shared, "key", "left_semi"), "keys")
    asks = F.col("open") < NEVER
    # Stars first: passages without a match, with one document of each of their keys, the widest at first, then others.
    for k in range(rounds):
        order = F.struct(~asks, (F.col("b") - F.col("a") if k == 0 else F.xxhash64("doc", F.lit(k))).cast("long"), "doc", "a", "b")
        heads = keys.groupBy("key").agg(F.max(order).alias("_h"), F.min("open").alias("_o")).where(F.col("_o") < NEVER)
        heads = scratch.keep(heads.select("key", F.col("_h.doc").alias("other"), F.col("_h.a").alias("ha"), F.col("_h.b").alias("hb")), "heads")
        pairs = scratch.keep(_pairs(keys.where(asks).join(heads, "key").where("doc <> other")), "pairs")
        late = _judge(pairs, rows, t, similarity, scratch)
        found = scratch.keep(late.select("doc").distinct(), "found")
        if found.isEmpty():
            break
        matched = scratch.keep(matched.unionByName(late).distinct(), "matched")
        again = _keys(tokens.join(found, "doc", "left_semi"), matched.join(found, "doc", "left_semi"), t, similarity).join(shared, "key", "left_semi")
        keys = scratch.keep(keys.join(found, "doc", "left_anti").unionByName(again.select(*keys.columns)), "keys")
    named = components(matched.select(F.col("doc").alias("u"), F.col("other").alias("v")).distinct(), scratch)
    live = scratch.keep(keys.join(named.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")), "live")
    # Keys of one component and of matched stretches only are settled.
    some = live.groupBy("key").agg(F.min("component").alias("_p"), F.max("component").alias("_q"), F.min("open").alias("_o"), F.count(F.lit(1)).alias("_n"))
    some = scratch.keep(some.where(f"_p <> _q or _o < {NEVER}").select("key", "_n"), "unsettled")
    parts = F.ceil(F.col("_n") / limit).cast("int")
    wanted = scratch.keep(live.join(some.select("key"), "key", "left_semi"), "wanted")
    marked = tokens.join(wanted.select("doc").distinct(), "doc", "left_semi").unionByName(wanted, allowMissingColumns=True)
    marked = marked.repartition("doc").sortWithinPartitions("doc").mapInPandas(_marks(t), MARKED)
    dealt = marked.join(some, "key").select("*", F.pmod(F.xxhash64("doc"), parts).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_other"))
    keyed = dealt.withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other")}).drop("_other", "_n")
    pairs = scratch.keep(_pairs(keyed.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInPandas(_candidates(t, similarity), STAR)), "pairs")
    return scratch.keep(matched.unionByName(_judge(pairs, rows, t, similarity, scratch)).distinct(), "matched")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, similarity: float = 0.8, rounds: int = 1, bucket: int = BUCKET, fan: int = FAN, limit: int = 2048) -> DataFrame:
    """doc_id, start and stop (words, stop exclusive), class_id and n_links of each repeated stretch."""
    scratch = Scratch(docs.sparkSession)
    t = words - SHINGLE + 1
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), whole(text_col).alias("_text"))
    some = candidates(rows, t, similarity, scratch, bucket, fan)
    rows = some.select("doc", "_text")
    size = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    buckets = 1 + size // bucket
    widths = _widths(buckets, fan)
    dealt = lambda blobs: blobs.repartition("bucket").sortWithinPartitions("bucket")
    blobs = some.mapInPandas(_cell_blobs(t, buckets, widths[0]), BLOB)
    for width in widths[1:]:
        blobs = dealt(blobs).mapInPandas(_refine(buckets, width, fan), BLOB)
    met = scratch.keep(dealt(blobs).mapInPandas(_meet, MEMBER), "met")
    copies = scratch.keep(met.where("kind = 1").select("doc", "other", F.col("a").alias("n_tokens")).distinct(), "copies")
    # A copy's links are those of the document it equals.
    texts = met.join(copies.select("doc").distinct(), "doc", "left_anti")
    members = scratch.keep(texts.where("kind = 0").drop("kind"), "members")
    tokens = scratch.keep(texts.where("kind = 2").select("doc", "key", "a", "b", "other", "ha"), "tokens")
    scratch.drop(met)
    found = _judge(scratch.keep(_pairs(members.where("other is not null")), "pairs"), rows, t, similarity, scratch)
    matched = _rest(tokens, found.distinct(), rows, t, similarity, scratch, rounds, limit)
    equal = copies.select("doc", "other", F.lit(0).alias("a"), (F.col("n_tokens") - (t - 1)).alias("n"))
    both_ways = scratch.keep(matched.unionByName(equal).unionByName(equal.select(F.col("other").alias("doc"), F.col("doc").alias("other"), "a", "n")).distinct(), "matches")
    spans = both_ways.select("doc", "a", (F.col("a") + F.col("n") + (words - 1)).alias("e")).distinct()
    order = Window.partitionBy("doc").orderBy("a", "e")
    new = (F.col("a") > F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    merged = spans.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order)).groupBy("doc", "_run").agg(F.min("a").alias("start"), F.max("e").alias("stop"))
    n_links = both_ways.select("doc", "other").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_links"))
    classes = components(both_ways.select(F.col("doc").alias("u"), F.col("other").alias("v")).distinct(), scratch)
    return (
        merged.join(n_links, "doc").join(classes.select(F.col("node").alias("doc"), F.col("component").alias("class_id")), "doc")
        .select(F.col("doc").alias("doc_id"), "start", "stop", "class_id", "n_links")
    )


def op7_substring_dedup(spark, sf_dir):
    return repeated_passages(documents(spark, sf_dir))
