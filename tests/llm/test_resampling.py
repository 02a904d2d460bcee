"""Importance resampling against a plain-Python version; the radix selection against sorting."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import registry, resampling

ITEMS = [(1, "the Quick brown fox, jumps"), (2, None), (3, ""), (4, "été 42 lazy dogs the the")]


def rows() -> list:
    r = random.Random(3)
    words = "the quick brown fox jumps over lazy dogs été 42 zeta Omega pi-rho x_y".split()
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for k in range(-20, 130)]
    docs += [(1000, None), (1001, ""), (1002, "...!\n\t"), (1003, "ab " * 30), (1004, "ab " * 30), (1005, "w" * 50 + " " + "the " * 3000)]
    return docs


def by_hand(docs, items, *, max_n=1, buckets=10_000, least=20, percent=10) -> dict:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def feats(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, max_n + 1) for k in range(len(w) - n + 1)]

    raw, target = [0] * buckets, [0] * buckets
    for side, texts in ((raw, docs), (target, items)):
        for _, t in texts:
            for b in feats(t):
                side[b] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(raw) + buckets) / ((s + 1) * (sum(target) + buckets)))) for s, t in zip(raw, target)]
    out, fit = [], []
    for n, (i, t) in enumerate(docs):
        f = feats(t)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(words(t)) >= least:
            fit.append(n)
    order = sorted(fit, key=lambda n: (-out[n][3], out[n][0] is None, out[n][0] or 0, out[n][1]))
    for rank, n in enumerate(order[: len(fit) * percent // 100], 1):
        out[n][4] = rank
    return sorted(map(tuple, out), key=str)


def found(docs, items, **options) -> list:
    got = resampling.resample(docs, items, **options)
    return sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, rank string, score int").repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("options", [{}, {"max_n": 3, "buckets": 500}, {"percent": 100, "least": 0}, {"percent": 0}])
def test_resample_equals_the_version_by_hand(documents, items, options):
    call = {("min_words" if k == "least" else k): v for k, v in options.items()}
    assert found(documents, items, **call) == by_hand(rows(), ITEMS, **options)


def test_pieces_of_long_texts_join(documents, items, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 16)
    for n in (1, 2, 4):
        for _, t in rows():
            whole = b" ".join((t or "").encode().translate(resampling.FOLD).split()).split()
            want = sorted(zlib.crc32(b" ".join(whole[k : k + m])) % 99 for m in range(1, n + 1) for k in range(len(whole) - m + 1))
            got = list(resampling.features((t or "").encode(), 99, n))
            assert sorted(np.concatenate([f for _, f in got]).tolist() if got else []) == want and sum(k for k, _ in got) == len(whole)


def test_repeated_rows_ids_and_nulls_are_drawn_one_by_one(spark, items):
    docs = [(7, "the quick " * 15)] * 40 + [(7, "the quick " * 20)] * 5 + [(None, "fox dogs " * 12)] * 10 + [(8, "pi rho " * 11)] * 5
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(frame, items, percent=50) == by_hand(docs, ITEMS, percent=50)


def test_empty_tables(spark, documents, items):
    assert found(documents.where("false"), items) == []
    assert found(documents, items.where("false")) == by_hand(rows(), [])


def test_draw_keeps_columns(documents, items):
    drawn = resampling.draw(documents, items)
    want = {i for i, *_, rank in by_hand(rows(), ITEMS) if rank}
    assert drawn.columns == documents.columns and {r.doc_id for r in drawn.collect()} == want


@pytest.mark.parametrize("digit", [2, 12])
def test_radix_selection_over_all_bits(spark, monkeypatch, digit):
    monkeypatch.setattr(resampling, "DIGIT", digit)
    r = random.Random(digit)
    edge = [-(1 << 63), (1 << 63) - 1, -1, 0, 1]
    keys = [(r.choice([*edge, r.randrange(-50, 50), r.getrandbits(62)]), r.choice([*edge, 5, r.getrandbits(40)])) for _ in range(300)]
    frame = spark.createDataFrame(keys, "a long, b long").repartition(3).cache()
    order = sorted(keys)
    for k in (1, 2, 97, 150, 299, 300):
        bound = resampling.kth_key(frame, ["a", "b"], k)
        assert tuple(bound) == order[k - 1]
        assert frame.where(resampling.up_to(["a", "b"], bound)).count() == sum(x <= order[k - 1] for x in order)


def test_numbered_ranges(spark):
    frame = spark.range(1000).select((F.col("id") * 37 % 1000).alias("a"), F.col("id").alias("b"))
    got = resampling.numbered(frame, ["a", "b"], "numbered").collect()
    assert sorted((r["rank"], r["a"]) for r in got) == [(k + 1, k) for k in range(1000)]


def test_query_reads_whole_tables(spark, documents, items, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.QUERIES["op11_resample"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {d for _, d in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows(), ITEMS)
