"""Quality classifier: weak labels by expectation maximisation, then a hashed linear scorer.

Eight overlapping heuristics vote good, bad or nothing on every document; each kind of defect is in reach of two or more.
Expectation maximisation over the counts of vote patterns (at most 3^8, summed over all documents) estimates how each heuristic votes on good and on bad documents,
and so a posterior for each pattern. The posteriors label a bounded sample - the `sample` documents with the least hash -
on which a logistic scorer over hashed words, word shapes and repetition features is fitted. The scorer decides.

Defined cases: null and empty texts, and those without words, have score 0 and are rejected; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored. Texts are read whole; nothing is shuffled but
pattern counts and the sample's features.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, release, small_batches, whole

SLOTS = 1 << 12
SYMBOLS = "#$%&*@^~|<>{}[]=+_\\"
LABELLERS = ("stutter", "variety", "shouting", "exclaiming", "symbols", "plainness", "length", "lines")


#: Letters or digits, with common punctuation around or inside.
PLAIN = lambda word, strip=".,;:!?'\"()-": word.strip(strip).replace("-", "").replace("'", "").isalnum()


def facts(text: str) -> tuple:
    """words, their number, and shares: stutter, variety, shouting, exclaiming, symbols, plain words, repeated lines (None: too few)."""
    words = text.split()
    n = len(words)
    if not n:
        return words, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        words, n, sum(map(operator.eq, words[1:], words)) / n, len(set(words)) / n**0.9, sum(map(str.isupper, words)) / n,
        text.count("!") / n, sum(map(text.count, SYMBOLS)) / n, sum(map(PLAIN, words)) / n, 1 - len(set(lines)) / len(lines) if len(lines) > 3 else None,
    )


def _vote(value, bad, good) -> str:
    """b, g or - for a share that is bad from `bad` up and good up to `good`."""
    return "-" if value is None else "b" if value >= bad else "g" if value <= good else "-"


NO_WORDS = "------b-"


def votes(f: tuple) -> str:
    """One letter for each labeller."""
    _, n, stutter, variety, shouting, exclaiming, symbols, plain, lines = f
    if not n:
        return NO_WORDS
    return "".join([
        _vote(stutter, 0.15, 0.03), _vote(-variety, -0.35, -0.6) if n >= 20 else "-", _vote(shouting, 0.5, 0.1) if n >= 3 else "-",
        _vote(exclaiming, 0.3, 0.05), _vote(symbols, 0.25, 0.1), _vote(-plain, -0.6, -0.85), "b" if n < 5 else "g" if n >= 25 else "-", _vote(lines, 0.4, 0.1),
    ])


def fit_labellers(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Posterior of good for each vote pattern, by expectation maximisation."""
    if not counts:
        return {}
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    seen = np.array([[[c == v for v in "bg"] for c in p] for p in patterns], float)  # pattern, labeller, vote; nothing said is nothing known
    prior = np.array([0.1, 0.9])
    rate = np.tile(np.array([[0.4, 0.6], [0.02, 0.98]])[:, None, :], (1, len(LABELLERS), 1))
    for _ in range(rounds):
        log = np.log(prior)[None] + np.einsum("plv,clv->pc", seen, np.log(rate))
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * weight[:, None]
        # Smoothed; no labeller is taken to say bad more readily of good documents than of bad ones.
        prior = (mass.sum(0) + 1) / (weight.sum() + 2)
        rate = np.einsum("pc,plv->clv", mass, seen) + np.array([[0.4, 0.6], [0.02, 0.98]])[:, None, :]
        rate /= rate.sum(2, keepdims=True)
        worse = rate[0, :, 0] < rate[1, :, 0]
        rate[:, worse, :] = rate[:, worse, :].mean(0)
    return dict(zip(patterns, post[:, 1].tolist()))


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % SLOTS


def word_slots(word: str) -> tuple[int, int]:
    """Slots of a word and of its shape."""
    shape = "U" if word.isupper() else "T" if word[0].isupper() else "l"
    shape += ("a" if word.isalpha() else "d" if word.isdigit() else "m") + ("" if word[-1].isalnum() else word[-1])
    return _slot("w:" + word.lower()), _slot("s:" + shape)


def extra_slots(f: tuple) -> list[int]:
    """Slots of the document-wide features, each of weight 1."""
    _, n, stutter, variety, shouting, exclaiming, symbols, plain, lines = f
    cut = lambda x, k: int(min(x, 1) * k + 0.5)
    return [
        _slot(f"stutter:{cut(stutter, 10)}"), _slot(f"variety:{cut(variety, 10)}"), _slot(f"shouting:{cut(shouting, 5)}"), _slot(f"bang:{cut(exclaiming, 5)}"),
        _slot(f"symbols:{cut(symbols, 8)}"), _slot(f"plain:{cut(plain, 8)}"), _slot(f"size:{min(len(bin(n)), 9)}"), _slot(f"lines:{-1 if lines is None else cut(lines, 5)}"),
    ]


def features(f: tuple) -> np.ndarray:
    x = np.zeros(SLOTS, np.float32)
    for w in f[0]:
        for s in word_slots(w):
            x[s] += 1
    x /= max(f[1], 1)
    for s in extra_slots(f):
        x[s] += 1
    return x


def fit_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent; both classes weigh the same."""
    if not len(x):
        return np.zeros(SLOTS), 0.0
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    weight = target / (2 * share) + (1 - target) / (2 * (1 - share))
    weight = (weight / weight.sum()).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    step = 4 / float(np.einsum("ij,ij->i", x, x).max() + 1)
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30)))
        g = (weight * (p - target)).astype(np.float32)
        nw, nb = vw - step * (x.T @ g + decay * vw), vb - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw.astype(np.float32), nb, nt
        vw = vw.astype(np.float32)
    return w, float(b)


class Scorer:
    """The fitted scorer; word weights are memoised in each worker."""

    def __init__(self, w: np.ndarray, b: float):
        self.w, self.b, self.memo = w.tolist(), b, None

    def score(self, f: tuple) -> float:
        if not f[1]:
            return 0.0
        if self.memo is None:
            w = self.w

            class Memo(dict):
                def __missing__(self, word):
                    a, b = word_slots(word)
                    if len(self) > 150_000:
                        self.clear()
                    self[word] = found = w[a] + w[b]
                    return found

            self.memo = Memo()
        z = self.b + sum(map(self.memo.__getitem__, f[0])) / f[1] + sum(self.w[s] for s in extra_slots(f))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000) -> tuple[dict[str, float], Scorer]:
    """Pattern posteriors from all documents, scorer from at most `sample` of them."""

    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)

    @F.pandas_udf("string")
    def ballot(text: pd.Series) -> pd.Series:
        return text.map(lambda t: votes(facts(t)))

    counts = {r["_v"]: r["n"] for r in rows.select(ballot("_text").alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior = fit_labellers(counts)
    total = sum(counts.values())

    def describe(batches):
        for b in batches:
            made = [(votes(f), features(f).astype(np.float16).tobytes()) for f in map(facts, b["_text"])]
            yield pd.DataFrame({"_h": b["_h"], "v": [m[0] for m in made], "x": [m[1] for m in made]})

    # Documents under a hash bound that about twice the sample meets, then the least hashes of them: all if fewer.
    hashed = rows.withColumn("_h", F.xxhash64("doc_id", F.xxhash64("_text")))
    if total > 4 * sample:
        hashed = hashed.where(F.col("_h") < int(-(2**63) + 2**64 * (2 * sample / total)))
    taken = hashed.select("_h", "_text").mapInPandas(describe, "_h long, v string, x binary").orderBy("_h", "v").limit(sample).toPandas()
    taken = taken[taken["v"] != NO_WORDS]
    x = np.stack([np.frombuffer(b, np.float16) for b in taken["x"]]).astype(np.float32) if len(taken) else np.zeros((0, SLOTS), np.float32)
    return posterior, Scorer(*fit_scorer(x, taken["v"].map(posterior).to_numpy(float)))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000, threshold: float = 0.5) -> DataFrame:
    """doc_id, votes, posterior, score and keep of every document."""
    posterior, scorer = fit(docs, id_col, text_col, sample)
    return _rows(docs, id_col, text_col).mapInPandas(_score_batches(posterior, scorer, threshold), f"doc_id {dict(docs.dtypes)[id_col]}, votes string, posterior double, score double, keep boolean")


def _score_batches(posterior, scorer, threshold):
    def run(batches):
        for b in batches:
            # One text's words at a time: a batch's would be many times its size.
            made = [(votes(f), scorer.score(f), f[1] > 0) for f in map(facts, b["_text"])]
            score = np.array([m[1] for m in made], float)
            yield pd.DataFrame({"doc_id": b["doc_id"], "votes": [m[0] for m in made], "posterior": [posterior.get(m[0], 0.0) for m in made], "score": score, "keep": (score >= threshold) & np.array([m[2] for m in made], bool)})

    return run


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000, threshold: float = 0.5) -> DataFrame:
    """docs without the rows the scorer rejects; all columns stay, no row is moved."""

    _, scorer = fit(docs, id_col, text_col, sample)

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for text in texts:
            yield pd.Series([f[1] > 0 and scorer.score(f) >= threshold for f in map(facts, text)], dtype=bool)
        release()

    return docs.where(good(whole(text_col)))


def op2_quality_classifier(spark, sf_dir):
    return quality_scores(documents(spark, sf_dir))
