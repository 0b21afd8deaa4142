import math
import zlib
from itertools import count

import zstandard
from sparkveil.llm import quality

GOOD = [" ".join(f"the {a} of {b} and that {c}" for a, b, c in zip(f"{k}alpha beta gamma delta".split(), "house tree river stone".split(), "runs stays falls goes".split())) + f" number {k}." for k in range(80)]
BAD = [" | ".join(f"{w}{k}$$$" for w in "BUY NOW CHEAP PILLS ORDER FAST".split()) for k in range(80)]


def test_model_tells_texts_apart():
    model = quality.fit(GOOD, BAD, 800, 200)
    good, bad = quality.score_texts(model, GOOD[:10]), quality.score_texts(model, BAD[:10])
    assert good.min() > 0.5 > bad.max()
    odd = quality.score_texts(model, [None, "", "x" * 1_000_000, "\U0001f600"])
    assert ((odd >= 0) & (odd <= 1)).all() and odd[0] == odd[1]


def test_without_labels(spark):
    for good, bad, score in ((GOOD, [], 1.0), ([], BAD, 0.0), ([], [], 0.5)):
        assert quality.score_texts(quality.fit(good, bad, len(good), len(bad)), ["a"])[0] == score
    docs = spark.createDataFrame([(1, "a", "extra")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model).collect()[0]["score"] == 0.5
    kept = quality.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == 1
    assert quality.score(docs.limit(0), model).count() == 0


def test_tiny_training_sample():
    model = quality.fit(["good words"], ["bad $$$"], 1, 1)
    assert 0 <= quality.score_texts(model, ["good words"])[0] <= 1


def test_learns_from_its_two_thirds_only(spark):
    rows = [(k, GOOD[k % 80] if k % 4 else BAD[k % 80]) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    straight = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k, _ in rows], "doc_id long, quality int, toxic int")
    twisted = spark.createDataFrame([(k, int(k % 4 > 0) ^ held(k), 1) for k, _ in rows] + [(None, 1, 0), (5, None, 0), (10**9, 0, 0)], "doc_id long, quality int, toxic int")
    a, b = quality.train(docs, straight), quality.train(docs, twisted)
    assert (a.good, a.bad) == (b.good, b.bad)


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    got = quality.op5_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(bad) > 100
    assert (good.predicted == 1).mean() > 0.98 and (bad.predicted == 0).mean() > 0.9
    assert all(bool(h) == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got.doc_id, got.held_out))


def plain_score(model, text):
    """The score of one text, written apart from the operator: block by block, sizes by a fresh compressor each."""
    data, s = (text or "").encode(), model.settings
    saved = 0
    for n in count():
        block = data[n * s.block_bytes : (n + 1) * s.block_bytes]
        if not block:
            break
        sizes = []
        for words in (model.bad, model.good):
            made = zstandard.ZstdCompressor(level=s.level, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(len(made.compress(block)))
        saved += sizes[0] - sizes[1]
    x = (saved + s.shrink_bytes * model.mean) / (len(data) + s.shrink_bytes)
    return 1 / (1 + math.exp(-min(40, max(-40, model.slope * x + model.offset))))


def test_scores_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "x" * 513), (10**6 + 3, "ö" * 4000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = {r["doc_id"]: r["score"] for r in quality.score(rows, model).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        assert abs(got[i] - plain_score(model, text)) < 1e-9, i


def test_fit_reads_a_bounded_window(spark):
    rows = [(k, ("good words of sense " if k % 2 else "$$$ ### %%% ") * 5000) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k, _ in rows], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, quality.Settings(fit_chars=600))
    assert all(0 <= plain_score(model, t) <= 1 for _, t in rows)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all((scores[k] >= 0.5) == bool(k % 2) for k in scores)
