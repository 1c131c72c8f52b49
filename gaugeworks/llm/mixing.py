"""Mixing to target weights with soft memberships.

A classifier fitted on the labelled table gives every document a posterior over domains; its words are its tokens.
Distributed projected gradient fits a rate >= 0 for every document, so that the expected tokens of each domain,
sum of rate x tokens x posterior, meet targets in the least-squares sense, each domain's gap measured against its own tokens
(a small domain's target counts as much as a large one's), starting from rate 1 for all (with max_rate, the projection also
holds rates at that). Measured so, and with steps scaled by a document's tokens, the curvature is 1 at most at any size,
so every step is a plain one of length 1. A round sums one number a domain; a document's rate is replayed from the
rounds' gradients, so nothing but a number a domain and round reaches the driver. Rounds end when every gap is within
`tolerance` of its target, when they stop gaining, or after `rounds`; mixture_report shows what is reached.

Targets: weights of the domains, of as many tokens as leave the anchor domain at its own; documents of a domain that has
less than its weight asks for get rates over 1. Only with max_rate is a target held at max_rate times what the domain has.
A domain without any label keeps what it has.

The classifier is Bernoulli naive Bayes over telling hashed words, on at most `sample` labelled rows (least hashes). Labels repeat or clash:
the greatest (toxic, -quality) of a document counts.

Defined cases: null and empty texts have no tokens, the prior as posterior, and the rate that this gives; labels with null
id, quality and toxic null count as quality 1 and toxic 0; without labels every document is of the anchor domain; an
empty table gives an empty result; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, tidy, whole

SLOTS = 1 << 18
#: Domains of the labelled table, and the default target weights.
DOMAINS = ("clean", "toxic", "low")
WEIGHTS = {"clean": 0.97, "toxic": 0.02, "low": 0.01}


def domain_of(quality, toxic):
    return F.when(F.coalesce(toxic, F.lit(0)) == 1, 1).when(F.coalesce(quality, F.lit(1)) == 0, 2).otherwise(0)


def _slot(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % SLOTS


class Bayes:
    """Bernoulli naive Bayes over telling slots: present and absent words count, words as common in every domain don't.

    A slot is telling if the share of a domain's documents that hold it is `lift` times the first domain's, and at least `least`
    documents and three in a hundred of some domain hold it. Slots that tell for the first domain are left out: with them,
    absent words of other languages and short texts make clean documents low, and without absent words long texts toxic.
    """

    def __init__(self, counts: np.ndarray, docs: np.ndarray, lift: float = 4.0, least: int = 8):
        self.docs = docs
        share = (counts + 0.5) / (docs[:, None] + 1)
        far = share >= lift * share[:1]
        known = (counts >= np.maximum(least, docs[:, None] * 0.03)).any(0)
        telling = np.flatnonzero(far.any(0) & known)
        share = share[:, telling]
        self.base = np.log((docs + 0.5) / (docs + 0.5).sum()) + np.log1p(-share).sum(1)
        self.gain = (np.log(share) - np.log1p(-share)).T
        self.place = {s: k for k, s in enumerate(telling.tolist())}
        self.memo: dict | None = None

    def posterior(self, words: list[str]) -> np.ndarray:
        if self.memo is None:
            place = self.place

            class Memo(dict):
                def __missing__(self, word):
                    if len(self) > 150_000:
                        self.clear()
                    self[word] = found = place.get(_slot(word), -1)
                    return found

            self.memo = Memo()
        at = set(map(self.memo.__getitem__, words))
        at.discard(-1)
        z = self.base + self.gain[sorted(at)].sum(0) if at else self.base
        p = np.exp(z - z.max())
        return p / p.sum()


def fit_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> Bayes:
    """Counts of documents that hold a word, by domain, on at most `sample` labelled rows; summed by the executors."""

    best = (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(F.struct(F.coalesce("toxic", F.lit(0)).alias("t"), (-F.coalesce("quality", F.lit(1))).alias("q"))).alias("_l"))
        .select("_id", domain_of(-F.col("_l.q"), F.col("_l.t")).alias("_domain"), F.xxhash64("_id").alias("_h"))
    )
    total = best.count()
    if total > sample:
        best = best.where(F.col("_h") < int(-(2**63) + 2**64 * (sample / total)))
    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).join(F.broadcast(best.select("_id", "_domain").limit(2 * sample)), "_id")

    def count(batches):
        made = np.zeros((len(DOMAINS), SLOTS + 1), np.int64)
        for b in batches:
            for domain, text in zip(b["_domain"], b["_text"]):
                made[domain, list({_slot(w) for w in set(text.split())})] += 1
                made[domain, SLOTS] += 1
        d, s = np.nonzero(made)
        yield pd.DataFrame({"domain": d.astype(np.int32), "slot": s.astype(np.int32), "n": made[d, s]})

    sums = rows.mapInPandas(tidy(count), "domain int, slot int, n long").groupBy("domain", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(DOMAINS), SLOTS + 1))
    counts[sums["domain"], sums["slot"]] = sums["n"]
    return Bayes(counts[:, :SLOTS], counts[:, SLOTS])


def memberships(docs: DataFrame, model: Bayes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens and a posterior column p0, p1, ... for each domain."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p{k}" for k in range(len(DOMAINS))]

    def run(batches):
        for b in batches:
            made = [(len(w), held.value.posterior(w)) for w in (t.split() for t in b["_text"])]
            p = np.array([m[1] for m in made]).reshape(-1, len(names))
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": np.array([m[0] for m in made], np.int64), **{n: p[:, k] for k, n in enumerate(names)}})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).mapInPandas(tidy(run), f"doc_id {kind}, tokens long, " + ", ".join(f"{n} double" for n in names))


def _rate(steps: list[np.ndarray], most: float | None = None):
    """Column: the rate after the rounds whose gradients are given; most bounds it from above."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    rounds = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    p = [F.col(f"p{k}") for k in range(len(DOMAINS))]
    bound = (lambda r: r) if most is None else (lambda r: F.least(F.lit(float(most)), r))
    return F.aggregate(rounds, rate, lambda r, g: bound(F.greatest(F.lit(0.0), r - sum((p[k] * g[k] for k in range(1, len(p))), p[0] * g[0]))))


def fit_rates(members: DataFrame, targets: np.ndarray, have: np.ndarray, rounds: int = 60, most: float | None = None, tolerance: float = 5e-3) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of each round, and the expected tokens reached. members: memberships(); have: its tokens by domain.

    Minimises the sum over domains of (reached - target)^2 / have. In a document's own tokens as unit, its gradient is the
    sum over domains of posterior x gap / have, and the greatest curvature is 1.
    """
    sums = [F.sum(F.col("_r") * F.col("tokens") * F.col(f"p{k}")).alias(f"s{k}") for k in range(len(DOMAINS))]
    scale = np.maximum(have, 1e-300)
    steps: list[np.ndarray] = []
    before = first = None
    while True:
        reached = np.array([x or 0.0 for x in members.withColumn("_r", _rate(steps, most)).agg(*sums).first()])
        gap = reached - targets
        loss = float((gap**2 / scale).sum())
        first = loss if first is None else first
        done = (np.abs(gap) <= tolerance * np.maximum(targets, tolerance * have)).all() or (before is not None and before - loss <= 1e-6 * first)
        if len(steps) >= rounds or done:
            return steps, reached
        before = loss
        steps.append(gap / scale)


def fit_mixture(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict | None = None, anchor: str = "clean", rounds: int = 60, max_rate: float | None = None, tolerance: float = 5e-3):
    """(classifier, gradients of the rounds, memberships table, tokens by domain: had, wanted, reached)."""
    scratch = Scratch(docs.sparkSession)
    model = fit_domains(docs, labels, id_col, text_col)
    members = scratch.keep(memberships(docs, model, id_col, text_col), "members")
    facts = members.agg(*[F.sum(F.col("tokens") * F.col(f"p{i}")) for i in range(len(DOMAINS))]).first()
    have = np.array([float(x or 0) for x in facts])
    if not have.sum():
        return model, [], members, (have, have, have)
    weight = np.array([(weights or WEIGHTS)[d] for d in DOMAINS])
    lead = DOMAINS.index(anchor)
    targets = have[lead] * weight / weight[lead]
    if max_rate is not None:
        targets = np.minimum(have * max_rate, targets)
    # Nothing tells the documents of a domain without labels apart.
    targets = np.where(model.docs > 0, targets, have)
    steps, reached = fit_rates(members, targets, have, rounds, max_rate, tolerance)
    return model, steps, members, (have, targets, reached)


def mixture_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row a domain: expected tokens before, target, expected tokens at the fitted rates, and those of the copies dealt."""
    _, steps, members, (have, targets, reached) = fit_mixture(docs, labels, id_col, text_col, **options)
    copies = copies_of(F.col("doc_id"), _rate(steps, options.get("max_rate")))
    dealt = members.agg(*[F.sum(copies * F.col("tokens") * F.col(f"p{k}")) for k in range(len(DOMAINS))]).first()
    rows = [(d, float(have[k]), float(targets[k]), float(reached[k]), float(dealt[k] or 0)) for k, d in enumerate(DOMAINS)]
    return docs.sparkSession.createDataFrame(rows, "domain string, tokens double, target double, expected double, dealt double")


def mixing_rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, tokens, p0.., rate of every document."""
    _, steps, members, _ = fit_mixture(docs, labels, id_col, text_col, **options)
    return members.withColumn("rate", _rate(steps, options.get("max_rate")))


def copies_of(id_col, rate):
    """How often a document enters the mix: the rate's whole part, and one more with the rest as chance (by its id's hash)."""
    chance = F.pmod(F.xxhash64(F.lit("mix"), id_col), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate + 1e-9) + F.when(chance < rate + 1e-9 - F.floor(rate + 1e-9), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs as the rates deal them: rows left out, kept or repeated, in place, without a shuffle."""

    model, steps, _, _ = fit_mixture(docs, labels, id_col, text_col, **options)
    most = options.get("max_rate")

    @F.pandas_udf("double")
    def rate(text: pd.Series) -> pd.Series:
        p = np.array([model.posterior(t.split()) for t in text]).reshape(-1, len(DOMAINS))
        r = np.ones(len(p))
        for g in steps:
            r = np.clip(r - p @ g, 0.0, most)
        return pd.Series(r)

    n = "_copies" + "_" * max(map(len, docs.columns))  # a name that no column has
    dealt = docs.withColumn(n, copies_of(F.col(id_col), rate(whole(text_col)))).where(F.col(n) > 0)
    return dealt.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op5_source_mixing(spark, sf_dir):
    rates = mixing_rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rates.select("doc_id", "tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", copies_of(F.col("doc_id"), F.col("rate")).alias("copies"))
