"""The whole pipeline, each stage held against brute force on what the stage before it kept."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from test_training_data import fingerprint, quality_corpus, rows_of, sentence, similar_links, table

import corpus_pipeline


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture
def corpus(spark, tmp_path):
    """(folder, good ids, toxic ids): good, bad, copied, nearly copied, toxic, odd, repeated and null rows."""
    rng = random.Random(31)
    good, bad = quality_corpus(rng)
    copies = [t[0].lower() + t[1:] for t in good[:30]]
    near = [t[:-1] + " added." for t in good[30:50]]
    toxic = [(sentence(rng, 40) + " trash clown stupid").capitalize() + "." for _ in range(40)]
    long = [sentence(rng, 9000).capitalize() + "."]
    texts = good + copies + near + toxic + long + bad + [None, "", " \n"]
    ids = list(range(len(texts)))
    n = len(good) + len(copies) + len(near)
    fine, poisoned = set(range(n)) | {n + len(toxic)}, set(range(n, n + len(toxic)))
    docs = table(spark, texts + [good[60], good[60], sentence(rng, 90).capitalize() + "."], [*ids, 60, 60, None])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i in poisoned), "x") for i in sorted(fine | poisoned)] + [(None, None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), fine, poisoned


def kept_by_components(rows):
    """One row of each group of rows linked by similarity or by fingerprint: that with the smallest id, nulls last."""
    texts = [r["text"] or "" for r in rows]
    prints = [fingerprint(t, 5) for t in texts]
    links = similar_links(texts) | {(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]


def told(rows):
    return sorted([(r["doc_id"], lower(r["text"])) for r in rows], key=str)


def test_pipeline_stage_by_stage(spark, corpus, monkeypatch):
    from gaugeworks.llm.packing import tokenizer_at

    folder, fine, poisoned = corpus
    given = {}

    def noted(name, stage):
        def call(spark, docs, sf_dir):
            given[name] = docs
            return stage(spark, docs, sf_dir)

        return name, call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(*s) for s in corpus_pipeline.STAGES])
    packed = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    assert len({tuple(d.columns) for d in given.values()}) == 1
    rows = {name: [r.asDict() for r in d.collect()] for name, d in given.items()}

    kept = [r["doc_id"] for r in rows["exact_dedup"]]
    assert collections.Counter(kept) == collections.Counter([*fine, *poisoned, 60, 60, None])  # quality rejects the bad and the blank

    groups = collections.defaultdict(list)
    for r in rows["exact_dedup"]:
        groups[lower(r["text"])].append(r)
    largest = [max(g, key=lambda r: -1 if r["doc_id"] is None else r["doc_id"]) for g in groups.values()]
    assert told(rows["near_dedup"]) == told(largest)

    assert told(rows["mixing"]) == told(kept_by_components(rows["near_dedup"]))

    mixed = [r["doc_id"] for r in rows["packing"]]
    came = {r["doc_id"] for r in rows["mixing"]}
    assert len(mixed) == len(set(mixed)) and set(mixed) <= came and came - poisoned <= set(mixed)
    assert 0 < len(poisoned & set(mixed)) < len(poisoned & came)

    tok = tokenizer_at(None)
    want = []
    for r in rows["packing"]:
        ids = tok.whole.encode(r["text"], add_special_tokens=False).ids + [0]
        want += [(r["doc_id"], a // 2048, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for a in range(0, len(ids), 2048)]
    assert sorted([(p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in packed], key=str) == sorted(want, key=str)
    places = collections.defaultdict(list)
    for p in packed:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for some in places.values():
        some.sort()
        assert [o for o, _ in some] == np.cumsum([0, *[n for _, n in some[:-1]]]).tolist() and sum(n for _, n in some) <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    table(spark, ["a"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path))) == {}
