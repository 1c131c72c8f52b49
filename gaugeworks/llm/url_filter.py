"""URL filters: a cascade of Bloom filters gives exact membership over the corpus's key universe without a join.

Level 1 encodes the listed keys; level 2 the unlisted keys that pass level 1; level 3 the listed keys that pass
level 2; and so on until nothing passes wrongly. A key of the universe is listed iff the first level it fails is an
even one. The universe is dealt into parts of about `part_keys` keys by their hash, and each part has a cascade of its own, built
in one task from its bounded keys. Cascades of up to `max_bytes` in all are broadcast; larger ones travel to the rows: rows are
dealt by part and salt, each task holds one part's cascade at a time, and a hot key's rows spread over `salts` tasks.

Defined cases: a null url, or one without "://", has empty host and path; the empty host is a key like any other; an
empty universe or list gives a cascade without levels (nothing listed); repeated rows give repeated results; null ids stay
null. Two keys that agree in 128 bits of hash, one listed and one not, raise an error.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

# The contract's rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def split_url(url):
    """(host, path) columns: host A-Z lower-cased, both empty without '://'."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits; null without one."""
    rule = verdict = None
    for action, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    return rule, verdict


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(a: np.ndarray, b: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit places of keys with hashes a and b, one column for each hash function."""
    x, y = _mix(a, 2 * level), _mix(b, 2 * level + 1) | np.uint64(1)
    return (x[:, None] + y[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


def depth_of(levels: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first level (from 1) that each key fails; one more than there are if none."""
    depth = np.full(len(a), 1, np.int64)
    open_ = np.arange(len(a))
    for n, (bits, hashes, words) in enumerate(levels, 1):
        at = _places(a[open_], b[open_], n, bits, hashes)
        hit = ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)
        open_ = open_[hit]
        depth[open_] = n + 1
    return depth


def levels_of(inside: tuple[np.ndarray, np.ndarray], outside: tuple[np.ndarray, np.ndarray]) -> list:
    """The levels for listed and unlisted keys, each given as two arrays of hashes."""
    levels: list = []
    while len(inside[0]):
        n_in, n_out, level = len(inside[0]), len(outside[0]), len(levels) + 1
        if level > 60:
            raise ValueError("a listed and an unlisted key have the same hashes")
        p = min(0.5, n_in * math.sqrt(0.5) / max(n_out, 1)) if not levels else 0.5
        bits = 64 * math.ceil(max(64, n_in * math.log2(1 / p) / math.log(2)) / 64)
        hashes = max(1, round(math.log2(1 / p)))
        at = np.unique(_places(*inside, level, bits, hashes))
        words = np.zeros(bits // 64, np.uint64)
        np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        levels.append((bits, hashes, words))
        at = _places(*outside, level, bits, hashes)
        wrong = ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)
        inside, outside = (outside[0][wrong], outside[1][wrong]), inside
    return levels


class Cascade:
    """Cascades by part: a table (part, levels) and, if they are small enough, a broadcast of it."""

    def __init__(self, table: DataFrame, parts: int, n_bytes: int, max_bytes: int):
        self.table, self.parts, self.n_bytes = table, parts, n_bytes
        small = n_bytes <= max_bytes
        self.held = table.sparkSession.sparkContext.broadcast({r["part"]: pickle.loads(r["levels"]) for r in table.collect()}) if small else None


def _hashes(key):
    return F.xxhash64(key).alias("_a"), F.xxhash64(F.lit(1), key).alias("_b")


def build_cascade(keys: DataFrame, max_bytes: int = 32 << 20, part_keys: int = 1 << 20) -> Cascade:
    """keys: distinct (key, listed) over the whole universe."""
    scratch = Scratch(keys.sparkSession)
    table = scratch.keep(keys.select(*_hashes(F.col("key")), F.col("listed")), "keys")
    parts = 1 + table.count() // part_keys

    def build(batches):
        part, held = None, []

        def made():
            if held:
                a, b, listed = (np.concatenate(x) for x in zip(*held))
                yield pd.DataFrame({"part": [part], "levels": [pickle.dumps(levels_of((a[listed], b[listed]), (a[~listed], b[~listed])))]}).astype({"part": "int32"})

        for batch in batches:
            where = batch["part"].to_numpy()
            for x in np.unique(where):
                if x != part:
                    yield from made()
                    part, held = x, []
                mine = batch[where == x]
                held.append((mine["_a"].to_numpy(), mine["_b"].to_numpy(), mine["listed"].to_numpy(bool)))
        yield from made()

    dealt = table.withColumn("part", F.pmod("_a", F.lit(parts)).cast("int")).repartition("part").sortWithinPartitions("part")
    built = scratch.keep(dealt.mapInPandas(build, "part int, levels binary"), "cascade")
    return Cascade(built, parts, built.agg(F.sum(F.octet_length("levels"))).first()[0] or 0, max_bytes)


def with_membership(rows: DataFrame, key_col: str, cascade: Cascade, salts: int = 16) -> DataFrame:
    """rows with boolean column listed."""
    parts = cascade.parts
    listed = lambda levels, a, b: depth_of(levels, a, b) % 2 == 0 if levels else np.zeros(len(a), bool)
    if cascade.held is not None:
        held = cascade.held

        @F.pandas_udf("boolean")
        def member(a, b):
            a, b = a.to_numpy(), b.to_numpy()
            out, part = np.zeros(len(a), bool), a % parts
            for x in np.unique(part):
                mine = part == x
                out[mine] = listed(held.value.get(int(x)), a[mine], b[mine])
            return pd.Series(out)

        return rows.withColumn("listed", member(*_hashes(F.col(key_col))))
    names, kinds = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    a, b = _hashes(F.col(key_col))
    data = rows.select(F.pmod(a, F.lit(parts)).cast("int").alias("_part"), F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int").alias("_salt"), a, b, F.struct(*names).alias("_row"), F.lit(None).cast("binary").alias("_levels"))
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    sent = cascade.table.select(F.col("part").alias("_part"), each, F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b"), F.col("levels").alias("_levels"))

    def probe(batches):
        import pyarrow as pa

        part, levels = None, None
        for batch in batches:
            head = batch["_levels"].is_valid().to_numpy(zero_copy_only=False)
            parts_, a, b = (batch[c].to_numpy(zero_copy_only=False) for c in ("_part", "_a", "_b"))
            # A part's cascade comes before its rows; columns stay in Arrow, so nothing is converted.
            cuts = np.append(np.flatnonzero(head), len(head))
            if cuts[0]:
                cuts = np.append(0, cuts)
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if head[x]:
                    part, levels, x = parts_[x], pickle.loads(batch["_levels"][x].as_py()), x + 1
                if x < y:
                    if (parts_[x:y] != part).any():
                        raise ValueError("rows of a part without its cascade")
                    hit = pa.array(listed(levels, a[x:y], b[x:y]))
                    yield pa.RecordBatch.from_arrays([batch[n].slice(x, y - x) for n in names] + [hit], names=names + ["listed"])

    flat = data.select("_part", "_salt", "_a", "_b", "_levels", "_row.*").unionByName(sent, allowMissingColumns=True)
    dealt = flat.repartition("_part", "_salt").sortWithinPartitions("_part", F.col("_levels").isNull())
    return dealt.mapInArrow(probe, kinds + ", listed boolean")


def judge_urls(pages: DataFrame, keys: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_bytes: int = 32 << 20, part_keys: int = 1 << 20) -> DataFrame:
    """page_id, host, path, rule, listed and verdict. keys: distinct (key, listed) of all hosts."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    marked = with_membership(rows, "host", build_cascade(keys, max_bytes, part_keys))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "listed")


def tracking_hosts(pages: DataFrame, url_col: str = "url", share: float = 0.25) -> DataFrame:
    """The key universe: every host, listed if at least `share` of its urls carry a utm_ or ref parameter."""
    host, _ = split_url(F.col(url_col))
    tracked = F.coalesce(F.col(url_col), F.lit("")).rlike(r"[?&](utm_|ref=)").cast("long")
    return pages.select(host.alias("key"), tracked.alias("_t")).groupBy("key").agg((F.sum("_t") >= share * F.count(F.lit(1))).alias("listed"))


def op9_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    keys = Scratch(spark).keep(tracking_hosts(pages), "hosts")
    return judge_urls(pages, keys)


OP9_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
s AS (SELECT page_id, url, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT host AS key, sum(CAST(regexp_matches(url, '[?&](utm_|ref=)') AS BIGINT)) >= 0.25 * count(*) AS listed FROM s GROUP BY host),
r AS (SELECT s.page_id, s.host, s.path, k.listed,
        CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
             WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
             WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
             WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
             WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM s JOIN k ON s.host = k.key)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IN ('com/fr/', 'org/') THEN 'allow'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
