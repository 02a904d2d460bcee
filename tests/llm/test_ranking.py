"""Preference-ranked quality: the fit against plain gradient descent, the cut, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest

from lumenfold.llm import ranking, registry

SCHEMA = "doc_id long, text string, score string, lang string"


def texts(n: int) -> dict:
    """Prose, and a fifth of junk of three kinds; id to (text, quality)."""
    r = random.Random(17)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "nu", "pe"]) for _ in range(r.randrange(1, 4)))
    out = {}
    for k in range(n):
        words = [word() for _ in range(r.randrange(30, 200))]
        kind = r.randrange(15)
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [words[0]] * len(words)
        elif kind == 2:
            words = [w + r.choice(["###", "%%%"]) for w in words]
        out[k] = " ".join(words) + ".", int(kind > 2)
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = texts(400)
    docs = spark.createDataFrame([(k, t, "x", "en") for k, (t, _) in rows.items()], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(k, q, 0) for k, (_, q) in rows.items()] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_fit_is_the_minimum_of_the_pairwise_loss():
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 4)) * [1, 10, 0.1, 0] + [0, 5, 0, 3]
    label = (x[:, 0] + x[:, 1] / 10 + r.normal(size=80) > 0.5).astype(int)
    i, j = ranking.pairs(label, 16)
    assert set(label[i]) == {1} and set(label[j]) == {0} and set(i) | set(j) == set(range(80))
    z = np.where(x.std(axis=0) > 1e-9, (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9), 0)
    loss = lambda w: np.logaddexp(0, -(z[i] - z[j]) @ w).mean() + ranking.PENALTY / 2 * w @ w
    w = np.zeros(4)
    for _ in range(20_000):
        gap = z[i] - z[j]
        w -= 0.2 * (-(gap / (1 + np.exp(gap @ w))[:, None]).mean(axis=0) + ranking.PENALTY * w)
    got = ranking.fit(x, label) * np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 0)
    assert loss(got) == pytest.approx(loss(w), abs=1e-5) and got == pytest.approx(w, abs=0.05)


def test_quantile_counts_weights():
    v = np.array([5.0, 1.0, 3.0, 2.0])
    assert ranking.quantile(v, np.ones(4), 0.5) == 2.5
    assert ranking.quantile(v, np.array([1.0, 3.0, 1.0, 1.0]), 0.5) == 1.5
    assert ranking.quantile(v, np.ones(4), 0.0) == 1.0 and ranking.quantile(v, np.ones(4), 1.0) > 5.0


def test_features_are_shares():
    once, twice = ranking.features("Ab cd, ef\n"), ranking.features("Ab cd, ef\n" * 50)
    assert np.allclose(once[:259], twice[:259]) and twice[260] == pytest.approx(0.98) and twice[263] > 0.9 and once[263] == 0
    assert not ranking.features(None).any() and not ranking.features("").any()
    assert ranking.features(" \n")[256:].tolist() == [0] * 8


def test_held_out_documents_are_told_apart(spark, tables, tmp_path):
    docs, labels = tables
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = registry.QUERIES["op13_quality"](spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got, truth = {r.doc_id: r for r in found.collect()}, texts(400)
    assert set(got) == set(truth)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [k for k, r in got.items() if r.held_out]
    assert len(held) > 50 and sum(got[k].predicted == truth[k][1] for k in held) >= 0.97 * len(held)


def test_labels_of_the_held_out_fold_are_never_learnt(spark, tables):
    docs, labels = tables
    other = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality")
    a, b = ranking.train(docs, labels), ranking.train(docs, other)
    assert np.array_equal(a.weights, b.weights) and a.offset == b.offset


def test_sample_takes_one_text_an_id(spark, tables):
    docs, labels = tables
    many = docs.unionAll(spark.range(2000).selectExpr("1L as doc_id", "concat('copy ', id % 3) as text", "'x' as score", "'en' as lang"))
    usable, rows = ranking.training_rows(many, labels, max_labels=40)
    got = rows.collect()
    assert len(got) <= 40 and len({r._id for r in got}) == len(got) and {r._label for r in got} == {0, 1}
    assert usable.where("_id is null").count() == 0
    _, rows = ranking.training_rows(many.where("doc_id = 1"), labels)
    assert rows.count() == 1


def test_every_label_is_learnt(spark, tables, monkeypatch):
    """Blocks hold each labelled document once as its own; a rare label stands in all of them; the quantile is that of all."""
    monkeypatch.setattr(ranking, "BLOCK", 40)
    monkeypatch.setattr(ranking, "FEW", 8)
    monkeypatch.setattr(ranking, "BINS", 4)
    rows = spark.range(12_700).selectExpr("id", "cast(id % 1000 != 0 as int) as label", f"cast(repeat('a', {4 * ranking.FEATURES}) as binary) as x")
    found = [(np.frombuffer(r.label, np.int8), np.frombuffer(r.own, bool), len(r.x)) for r in ranking.blocks(rows, 12_687, 13).select("label", "own", "x").collect()]
    assert len(found) == 318 and sum(own.sum() for _, own, _ in found) == 12_700
    assert all((label == 0).sum() == 13 and size == 4 * ranking.FEATURES * len(label) for label, _, size in found)
    r = np.random.default_rng(4)
    v, w = np.round(r.normal(size=500), 3), r.choice([1.0, 2.5], 500)
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, w)], "s double, weight double")
    for share in (0.0, 0.31, 1.0):
        assert ranking.cut_at(frame, share) == pytest.approx(ranking.quantile(v, w, share), abs=1e-3)
    _, all_rows = ranking.training_rows(*tables)
    assert all_rows.count() == sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in range(400))
    assert not hasattr(ranking, "MAX_LABELS")


def test_odd_tables(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(1, None, "x", None), (1, "", "x", None), (None, "ka lo", "y", None), (2, "ka " * 100_000, "y", None)], SCHEMA)
    scored = ranking.score(odd, ranking.train(docs, labels), output="own")
    assert scored.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "own"]
    assert all(0 <= r.own <= 1 for r in scored.collect()) and scored.count() == 4
    assert ranking.score(odd.where("false"), ranking.train(docs, labels), output="own").count() == 0
    for kept, want in ((labels.where("quality = 1"), None), (labels.where("false"), 0.5)):
        n1 = len([k for k, (_, q) in texts(400).items() if q and zlib.crc32(str(k).encode()) % 5]) + int(zlib.crc32(b"9999") % 5 > 0)
        got = {round(r.own, 9) for r in ranking.score(odd, ranking.train(docs, kept), output="own").collect()}
        assert got == {round(want or (n1 + 1) / (n1 + 2), 9)}
    assert ranking.train(docs.where("false"), labels).weights.tolist() == [0.0] * ranking.FEATURES


def test_keep_best_keeps_columns_and_good_rows(spark, tables):
    docs, labels = tables
    kept = ranking.keep_best(docs, labels)
    truth, got = texts(400), {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert len(got & {k for k, (_, q) in truth.items() if q}) >= 0.98 * sum(q for _, q in truth.values())
    assert len(got & {k for k, (_, q) in truth.items() if not q}) <= 0.05 * len(truth)
