import corpus_pipeline
from lumenfold.llm.scratch import materialize


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    import random

    r = random.Random(1)
    plain = [" ".join(f"w{r.randrange(500)}" for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(plain)]
    rows += [(100, plain[0], "en", "s0", 0), (101, plain[1] + " dunce blockhead", "en", "s1", 0), (102, None, None, None, None), (103, "", "en", "s0", 0), (104, " ".join(f"bench{k}" for k in range(20)), "en", "s0", 0)]
    rows += [(200 + i, f"{t} dunce blockhead", "en", "s2", 0) for i, t in enumerate(plain[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i >= 200)) for i, *_ in rows if i < 50 or i >= 200], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, ids = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
        ids.append({x.doc_id for x in kept.collect()})
    assert not {i for i in ids[0] if i >= 200} and 101 not in ids[0] and set(range(60)) <= ids[0]
    assert 100 not in ids[1] and set(range(60)) <= ids[1] and 104 in ids[1] and 104 not in ids[2] and {102, 103} <= ids[2]
    last = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert last.count() == kept.count()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_stages_bear_odd_columns_repeated_rows_and_long_texts(spark, tmp_path):
    import random

    r = random.Random(2)
    extra = ["toxicity", "contamination", "dropped", "dropped_hash", "mix_key", "mix_copies", "score", "row", "doc", "_id", "_label", "h1", "words"]
    plain = [" ".join(f"w{r.randrange(800)}" for _ in range(50)) for _ in range(40)]
    long = " ".join(f"x{r.randrange(10**6)}" for _ in range(500_000))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(plain)] + [(500, plain[0], "en", "s", 0), (3, plain[3], "en", "s", 0), (600, long, "en", None, 0), (None, plain[7], "en", "s", 0), (601, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame([(*row, *[f"{c} of {row[0]}" for c in extra]) for row in rows], names)
    spark.createDataFrame([(i, int(i % 2)) for i in range(20)], "doc_id long, toxic int").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(plain[9].split()[:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert len(long) > 3 << 20
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
        for row in kept.collect():
            assert [row[c] for c in extra] == [f"{c} of {row.doc_id}" for c in extra]
        if name == "minhash_near_dedup":
            ids = sorted((x.doc_id is None, x.doc_id or 0) for x in kept.select("doc_id").collect())
            assert (False, 500) not in ids and ids.count((False, 3)) == 2 and (False, 600) in ids and (True, 0) in ids
        if name == "benchmark_decontamination":
            ids = {x.doc_id for x in kept.select("doc_id").collect()}
            assert 9 not in ids and {600, 601, None, *range(9)} <= ids
    last = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert last.count() == kept.count()
