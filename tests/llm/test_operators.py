"""Each operator against a brute-force version, and its defined results on nulls, empties, ties and repeats."""

import hashlib
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, linededup, lmscore, mixing, neardup, pii, registry, suffixdedup, tokens, topk, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, size string"


def sentence(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def texts() -> dict:
    base = sentence(1, 80)
    changed = base.split()
    changed[40] = "other"
    return {
        0: base,
        1: base,
        2: " ".join(changed),
        3: None,
        4: "",
        5: "one two",
        6: "One TWO",
        7: sentence(2, 6000),
        8: sentence(3, 60) + " " + sentence(1, 30) + " " + sentence(4, 20),
        9: "ab" * 300,
        10: "\n\n  \t",
        11: sentence(5, 50) + "\n" + sentence(6, 12),
        12: "é" * 120 + sentence(6, 40),
        13: "é" * 120 + " tail",
    }


@pytest.fixture(scope="module")
def documents(spark):
    """Clashing extra columns, a null source, one hot source."""
    rows = [(i, t, "en", None if i == 5 else "a" if i % 3 else "b", None, "x", "y") for i, t in texts().items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, repeated ids with other texts, null ids."""
    return spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6"), (1, "w1 w2 w3 w4 w5 w6"), (1, "else"), (None, "w1 w2 w3 w4 w5 w6"), (None, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars")


@pytest.fixture(scope="module")
def empty(documents):
    return documents.where("false")


# --- 1 mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mixing_targets_and_counts(documents):
    rows = mixing.decide(documents).collect()
    sizes = {}
    for i, t in texts().items():
        source = None if i == 5 else "a" if i % 3 else "b"
        sizes[source] = sizes.get(source, 0) + words(t)
    weights, left, total = {"a": 5.0, "b": 2.0, None: 1.0}, dict(sizes), 1.5 * sum(sizes.values())
    targets = {}
    while left:  # clamp and share again
        level = total / sum(weights[s] for s in left)
        full = [s for s in left if level * weights[s] > 2 * sizes[s]]
        for s in full or list(left):
            targets[s] = 2.0 * sizes[s] if full else level * weights[s]
            total -= targets[s]
            del left[s]
        if not full:
            break
    for r in rows:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source] and r["size"] == words(texts()[r.doc_id]) and 0 <= r.copies <= 2
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in mixing.decide(documents.repartition(5)).collect())


def test_mixing_hits_targets_of_many_documents(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 17 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source")
    by = {}
    for r in mixing.decide(docs).collect():
        t = by.setdefault(r.source, [0, r.target])
        t[0] += r.copies * r["size"]
    assert all(abs(got - target) <= 20 for got, target in by.values())


def test_mix_rows(documents, odd, empty):
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    want = {r.doc_id: r.copies for r in mixing.decide(documents).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mix(odd).count() >= 5 and mixing.mix(empty).count() == 0 and mixing.decide(empty).count() == 0


# --- 2 lines


def test_line_dedup(spark, empty):
    line = sentence(9, 14)
    near = line.replace(line.split()[7], line.split()[7] + "x")
    docs = spark.createDataFrame([(1, f"{line}\nshort\n\n"), (2, f"{near}\nSHORT \n{sentence(10, 14)}"), (3, None), (4, ""), (None, line)], "doc_id long, text string")
    shingle = lambda s: {s[i : i + linededup.SHINGLE] for i in range(len(s) - linededup.SHINGLE + 1)}
    a, b = shingle(line.lower()), shingle(near.lower())
    assert len(a & b) / len(a | b) >= linededup.SIMILARITY
    kept = {r.doc_id: (r.n_lines, r.kept) for r in linededup.decide(docs).collect()}
    assert kept == {1: (4, [0, 1, 2, 3]), 2: (3, [2]), 3: (0, []), 4: (1, [0]), None: (1, [])}
    out = {r.doc_id: r.text for r in linededup.dedup(docs).collect()}
    assert out == {1: f"{line}\nshort\n\n", 2: sentence(10, 14), 3: None, 4: "", None: ""}
    assert linededup.decide(empty).count() == 0


def test_line_links_against_all_pairs(spark):
    import random

    r = random.Random(4)
    lines = []
    for k in range(60):
        base = sentence(100 + k, 12)
        lines.append(base)
        for _ in range(3):
            at = r.randrange(len(base))
            lines.append(base[:at] + r.choice("qxz") + base[at + 1 :])
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    split = linededup.distinct_lines(linededup.split_lines(linededup._numbered(docs, "doc_id", "text")))
    found = {tuple(sorted((x.a, x.b))) for x in linededup.links(split).collect()}
    lids = {x.norm: x.lid for x in split.collect()}
    sets = {lids[n]: {n[i : i + linededup.SHINGLE] for i in range(len(n) - linededup.SHINGLE + 1)} for n in lids}
    near = lambda p, q: len(sets[p] & sets[q]) >= linededup.SIMILARITY * len(sets[p] | sets[q])
    assert all(near(p, q) for p, q in found)
    parts = {}
    root = lambda x: x if parts.get(x, x) == x else root(parts[x])
    for p, q in found:
        parts[root(p)] = root(q)
    keys = sorted(sets)
    true = [(p, q) for i, p in enumerate(keys) for q in keys[:i] if near(p, q)]
    assert true and sum(root(p) == root(q) for p, q in true) >= 0.95 * len(true)


def test_line_links_inside_one_large_bucket(spark, monkeypatch):
    import random

    r = random.Random(8)
    shared = sentence(500, 12)
    lines = []
    for k in range(40):
        base = shared + " " + sentence(600 + k, 12)
        lines += [base, base + " q", base + " qz"]
    r.shuffle(lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    split = linededup.distinct_lines(linededup.split_lines(linededup._numbered(docs, "doc_id", "text")))
    # one bucket of all lines: its ends belong to two of the forty families
    monkeypatch.setattr(linededup, "signatures", lambda x: x.select("lid").distinct().selectExpr("lid", "array(1L) as bands"))
    for chunk_rows in (1000, 16):
        found = [(x.a, x.b) for x in linededup.links(split, chunk_rows=chunk_rows).collect()]
        lids = {x.norm: x.lid for x in split.collect()}
        sets = {lids[n]: {n[i : i + linededup.SHINGLE] for i in range(len(n) - linededup.SHINGLE + 1)} for n in lids}
        near = lambda p, q: len(sets[p] & sets[q]) >= linededup.SIMILARITY * len(sets[p] | sets[q])
        parts = {}
        root = lambda x: x if parts.get(x, x) == x else root(parts[x])
        assert all(near(p, q) for p, q in found)
        for p, q in found:
            parts[root(p)] = root(q)
        keys = sorted(sets)
        true = [(p, q) for i, p in enumerate(keys) for q in keys[:i] if near(p, q)]
        assert len(true) >= 120 and all(root(p) == root(q) for p, q in true)


def test_a_large_family_of_lines_is_not_compared_pair_by_pair(spark, monkeypatch):
    import random

    r = random.Random(5)
    base = sentence(900, 60)[:300]
    variants = set()
    while len(variants) < 600:  # two of ten places changed: those that share a place are similar, the others are not
        t = list(base)
        for at in r.sample(range(15, 295, 28), 2):
            t[at] = r.choice("qxz7835ghk")
        variants.add("".join(t))
    docs = spark.createDataFrame(list(enumerate(sorted(variants))), "doc_id long, text string")
    split = linededup.distinct_lines(linededup.split_lines(linededup._numbered(docs, "doc_id", "text")))
    monkeypatch.setattr(linededup, "signatures", lambda x: x.select("lid").distinct().selectExpr("lid", "array(1L) as bands"))
    compared, inner = [], linededup._compared
    monkeypatch.setattr(linededup, "_compared", lambda pairs, *more: compared.append(pairs.count()) or inner(pairs, *more))
    found = linededup.links(split)
    root = {x.node: x.root for x in linededup.components(found).collect()}
    assert len(root) == 600 and len(set(root.values())) == 1
    assert sum(compared) < 25 * 600


def test_near_copies_of_short_lines(spark):
    docs = spark.createDataFrame([(1, "page footer no 1"), (2, "page footer no 12"), (3, "page foo"), (4, "page fooo")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in linededup.decide(docs).collect()} == {1: [0], 2: [], 3: [0], 4: [0]}


def test_lines_of_repeated_rows_and_clashing_columns(spark):
    line, other = sentence(9, 14), sentence(10, 14)
    rows = [(1, f"{line}\n\n{other}", "a", "b"), (1, f"{line}\n\n{other}", "a", "b"), (2, f"{other}\tx  y\n{line}", None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, line_no string").withColumn("c0", F.lit(1)).coalesce(1)
    out = linededup.dedup(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.row, r.line_no, r.c0) for r in out.collect() if r.doc_id == 1) == [(1, "", "a", "b", 1), (1, f"{line}\n\n{other}", "a", "b", 1)]
    assert sorted(len(r.kept) for r in linededup.decide(docs).where("doc_id = 1").collect()) == [1, 3]
    long = "\n".join(f"{sentence(7000 + k % 900, 8)} {k % 900}" for k in range(30_000))
    assert [(r.n_lines, len(r.kept)) for r in linededup.decide(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()][0][0] == 30_000


def test_recall_of_a_family_of_variants(spark):
    import random

    r = random.Random(17)
    base = sentence(77, 16)
    variants = {base}
    while len(variants) < 250:
        t = list(base)
        for _ in range(r.randrange(1, 3)):
            t[r.randrange(len(t))] = r.choice("qxz7")
        variants.add("".join(t))
    docs = spark.createDataFrame(list(enumerate(sorted(variants))), "doc_id long, text string")
    split = linededup.distinct_lines(linededup.split_lines(linededup._numbered(docs, "doc_id", "text")))
    lids = {x.lid: x.norm for x in split.collect()}
    sets = {k: {n[i : i + linededup.SHINGLE] for i in range(len(n) - linededup.SHINGLE + 1)} for k, n in lids.items()}
    root = {x.node: x.root for x in linededup.components(linededup.links(split)).collect()}
    keys = sorted(sets)
    true = [(p, q) for i, p in enumerate(keys) for q in keys[:i] if len(sets[p] & sets[q]) >= linededup.SIMILARITY * len(sets[p] | sets[q])]
    assert len(true) > 100 and sum(root.get(p, p) == root.get(q, q) for p, q in true) >= 0.95 * len(true)


# --- 3 toxicity


def test_toxicity(spark, empty):
    rows = [(i, sentence(i, 30) + (" you utter Blockhead fool" if i % 4 == 0 else "")) for i in range(200)] + [(900, None), (901, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' score", "1 label")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.s for r in toxicity.score(docs, model, output="s").collect()}
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    right = [(got[i] >= 0.5) == (i % 4 == 0) for i in range(200) if i in held]
    assert len(right) > 20 and sum(right) == len(right) and got[900] == got[901] < 0.5
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {900, 901} and not {r.doc_id for r in kept.collect()} & set(range(0, 200, 4))
    assert toxicity.reject(empty, labels).count() == 0 and toxicity.reject(docs, labels.where("false")).count() == len(rows)


def test_toxicity_learns_one_text_an_id(spark):
    """A labelled id a hundred thousand times, with three texts, is one row of the sample."""
    docs = spark.range(100_000).selectExpr("1L as doc_id", "concat('copy ', id % 3) as text").unionAll(spark.createDataFrame([(2, "you dunce"), (3, "fine text"), (4, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    for bound in (2, 100):
        usable, rows = toxicity.training_rows(docs, labels, max_labels=bound)
        got = rows.collect()
        assert len(got) == len({r._id for r in got}) == min(bound, usable.count())
    again = toxicity.training_rows(docs.repartition(7), labels)[1]
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.collect()))


def test_toxicity_held_out_is_crc32(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


# --- 4 decontamination


ITEMS = {1: sentence(1, 30), 2: "one two", 3: None, 4: "", 5: sentence(6, 13), 6: sentence(77, 40)}


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, documents, odd, empty, block_bytes):
    items = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    found = decontaminate.annotate(documents, items, output="f", block_bytes=block_bytes).withColumn("hits", decontaminate.n_hits("f"))
    want = decontaminate.brute_force(texts(), ITEMS)
    for r in found.collect():
        names = ",".join(sorted(map(str, r.f["items"])))
        assert (r.f.words, r.hits, len(r.f["items"]), hashlib.sha256(names.encode()).hexdigest()) == want[r.doc_id][:4]
        assert all(a < b for a, b in zip(r.f.starts, r.f.ends)) and all(b < c for b, c in zip(r.f.ends, r.f.starts[1:]))
    clean = decontaminate.drop_contaminated(documents, items, block_bytes=block_bytes)
    assert clean.columns == documents.columns and {r.doc_id for r in clean.collect()} == {d for d, w in want.items() if not w[4]}
    assert decontaminate.annotate(empty, items).count() == 0 and decontaminate.drop_contaminated(odd, items.where("false")).count() == 5


def test_fm_index_search_and_locate():
    import numpy as np

    r = np.random.default_rng(3)
    text = np.append(r.integers(1, 5, 400), 0)
    index = decontaminate.FMIndex(text.astype(np.int32), 4, sample=7)
    for n in (1, 3, 6):
        for at in (0, 17, 200):
            phrase = text[at : at + n]

            class One:
                lengths, matrix = np.array([n]), phrase.reshape(1, -1).astype(np.int64)

            low, high = index.search(One)
            places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert places == [k for k in range(401 - n) if (text[k : k + n] == phrase).all()]


# --- 5 repeats


def removed(frame, **options) -> dict:
    out = {}
    for r in suffixdedup.removals(frame, **options).collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)))
    return {k: sorted(v) for k, v in out.items()}


def wanted(rows) -> dict:
    out = {}
    for (doc, _), row in zip(rows, suffixdedup.brute_force([(suffixdedup.LAST if d is None else d, t) for d, t in rows])):
        out.setdefault(doc, []).append(row)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("split", [2000, 1])
def test_repeats(documents, empty, split):
    assert removed(documents, split=split) == wanted(list(texts().items()))
    assert suffixdedup.removals(empty).count() == 0


def passages(n: int) -> list:
    """Texts that share passages of many lengths with others and with themselves; some ids stand on several rows."""
    import random

    r = random.Random(11)
    shared = [sentence(900 + k, 24) for k in range(6)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(r.randrange(1, 6)):
            s = r.choice(shared)
            a = r.randrange(len(s) - 60)
            parts += [s[a : a + r.randrange(60, 260)], sentence(r.randrange(10**6), r.randrange(6))]
        rows.append((r.randrange(n) if k % 3 else k, " ".join(parts)))
    return rows + [rows[0], (None, rows[1][1]), (None, rows[2][1]), (None, None)]


@pytest.mark.parametrize("split, lot", [(4096, 1 << 18), (3, 1 << 18), (4096, 1500)])
def test_repeats_of_many_passages(spark, monkeypatch, split, lot):
    monkeypatch.setattr(suffixdedup, "LOT_BYTES", lot)
    rows = passages(120)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removed(frame, split=split) == wanted(rows)


def test_repeats_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK", 3000)
    long = " ".join(t for _, t in passages(60) if t)
    rows = [(1, long), (2, long[500:9000] + "new" + long[:2000]), (3, "ab" * 4000), (4, "ab" * 90 + long[100:400])]
    assert len(long) > 20_000 and removed(spark.createDataFrame(rows, "doc_id long, text string")) == wanted(rows)


def test_matching_statistics_come_from_the_samples():
    import numpy as np

    strings = [t.encode() for _, t in passages(30) if t]
    index = suffixdedup.RunIndex(strings, 40)

    def longest(q, at):
        n = 0
        while at + n < len(q) and any(q[at : at + n + 1] in s for s in strings):
            n += 1
        return n

    queries = [strings[3][:70] + b"#" + strings[5][30:120], b"#?", strings[7], b"zz" + strings[1][5:60]]
    got = {(int(k), int(a)): (int(m), int(r)) for ks, ats, ms, rows in index.statistics(queries) for k, a, m, r in zip(ks, ats, ms, rows)}
    text = b"\0".join([*strings, b""])
    for (k, at), (m, row) in got.items():
        assert m == longest(queries[k], at)
        place = int(index.order[row])
        assert text[place : place + m] == queries[k][at : at + m]
    # with wrong samples the statistics are wrong
    index.sample_first, index.sample_last = np.zeros_like(index.sample_first), np.zeros_like(index.sample_last)
    broken = {(int(k), int(a)): int(m) for ks, ats, ms, _ in index.statistics(queries) for k, a, m in zip(ks, ats, ms)}
    assert broken != {key: m for key, (m, _) in got.items()}


def test_segments_depend_on_content_only():
    import numpy as np

    def of(data):
        found = suffixdedup.segments(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))
        return [tuple(c) for c in found[[1, 2, 4]].T.tolist()]

    body = sentence(5, 60).encode()
    for before in (b"", b"x", sentence(8, 30).encode()):
        whole = of(before + body)
        inner = {(a, w) for a, w, f in whole if f > len(before)}
        plain = {(a, w) for a, w, f in of(body) if f > 0}
        assert plain <= inner | {(a, w) for a, w, _ in whole}


# --- 6 top k


def test_topk(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).round(1).tolist()) for i in range(400)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [0.1] * 3), (None, [1.0] * 8), (404, [0.3] * 8), (405, [0.3] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 rank", "2 score").repartition(3)
    got = [(x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(vectors, vectors.where("vec_id % 100 = 0"), query_rows=2, block_rows=16).orderBy("query_id", "rank").collect()]
    fine = {i: np.floor(1024 * np.pad(np.array(v, float), (0, 8 - len(v)))).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(i for i in fine if i % 100 == 0):
        best = sorted(((-int(fine[q] @ v), i) for i, v in fine.items() if i != q))[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == want
    assert topk.search(vectors.where("false"), vectors).count() == 0 and topk.search(vectors, vectors.where("false")).count() == 0


def best_of(blocks, ids, queries, k):
    import numpy as np

    best: dict = {}
    for b in blocks:
        b.search(np.array(ids), np.array(queries), k, best)
    return {q: (i.tolist(), s.tolist()) for q, (i, s) in best.items()}


def test_topk_prunes_and_keeps_exact_sums():
    import numpy as np

    ids, values = np.arange(512), np.zeros((512, 2))
    values[:, 0] = ids
    blocks = topk.Blocks(ids, values, 32)
    assert best_of([blocks], [-1], [[1.0, 0.0]], 3)[0][0] == [511, 510, 509] and blocks.scored == 1
    low = topk.Blocks(ids + 1000, values - 600, 32)  # the kth score of an earlier range rules all of it out
    assert best_of([blocks, low], [-1], [[1.0, 0.0]], 3)[0][0] == [511, 510, 509] and low.scored == 0
    big = topk.Blocks(np.array([1, 2]), np.array([[2.0**30, 1.0], [2.0**30, 2.0]]), 1)
    assert best_of([big], [9], [[2.0**30, 1.0]], 2)[0][1] == [2**60 + 2, 2**60 + 1]


def test_topk_returns_k_rows_a_query_from_each_run(spark, monkeypatch):
    seen = []
    vectors = spark.range(0, 3000, 1, 2).selectExpr("id as vec_id", "array(cast(id % 97 as double), 1D) as embedding")
    frame_of = type(vectors).withColumn
    monkeypatch.setattr(type(vectors), "withColumn", lambda self, name, col: (seen.append(self) if name == "rank" else None) or frame_of(self, name, col))
    assert topk.search(vectors, vectors.where("vec_id % 100 = 0"), k=4, range_rows=100).count() == 30 * 4
    [found] = seen
    assert found.count() <= 4 * 30 * spark.sparkContext.defaultParallelism
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("run", "group"), [(1, 1), (500, 200), (1 << 20, 1 << 20)])
def test_topk_in_many_runs_and_groups(spark, monkeypatch, run, group):
    """However runs and query groups are cut, and whatever widths meet, the results are the same."""
    import numpy as np

    monkeypatch.setattr(topk, "RUN_BYTES", run)
    monkeypatch.setattr(topk, "GROUP_BYTES", group)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=r.integers(1, 7)).round(2).tolist()) for i in range(150)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(vectors, vectors.where("vec_id % 10 = 0"), k=5, query_rows=4, block_rows=8, range_rows=20).orderBy("query_id", "rank").collect()]
    fine = {i: np.floor(1024 * np.pad(np.array(v), (0, 8 - len(v)))).astype(int) for i, v in rows}
    want = []
    for q in range(0, 150, 10):
        best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == want


# --- 7 near duplicates


def brute_components(docs: dict, size: int, percent: int) -> dict:
    sets = {i: set(neardup.shingles(t, size).tolist()) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(docs)
    for n, i in enumerate(keys):
        for j in keys[:n]:
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in docs}


def near_copies(n: int) -> dict:
    import random

    r, out = random.Random(2), {}
    for k in range(n):
        ws = sentence(50 + k % 3, 70).split()
        for _ in range(k % 5):
            ws[r.randrange(70)] = f"new{k}"
        out[k] = " ".join(ws)
    return out


@pytest.mark.parametrize("limit", [1024, 4])
def test_near_duplicates(spark, documents, empty, limit):
    for docs, frame in ((texts(), documents), (near_copies(40), spark.createDataFrame(list(near_copies(40).items()), "doc_id long, text string"))):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.find(frame, size=3, percent=85, cluster_rows=limit).collect()}
        assert got == brute_components(docs, 3, 85)
    assert neardup.find(empty).count() == 0


def test_keep_one(documents, odd):
    kept = neardup.keep_one(documents)
    want = brute_components(texts(), 5, 80)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert neardup.keep_one(odd).count() == 5


# --- 8 personal data


def base_spans(t: str) -> list:
    def luhn(d):
        return sum((x * 2 - 9 if x > 4 else x * 2) if k % 2 else x for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, fine) in tests.items() for m in re.finditer(p, t or "") if fine(m)]


PII = ["a@b.c_d@e.f g@h", "é 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 1-2-3", "+1 (906) 555-7738 +123 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "mail: joe (at) site.com call (906) 555-7738", "", None, "@@a@b..c a@b.c. x@y.z-", "4" * 3000 + " " + "1 " * 2000 + "a." * 2000 + "a@b" + ".c" * 2000, "x" * 20000]


def test_pii(spark, empty):
    rows = list(enumerate(PII)) + [(None, "q@r.st"), (0, "q@r.st")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' kind", "1 spans_", "2 m_email")
    found = pii.find(docs)
    got = sorted((r.doc_id if r.doc_id is not None else -1, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in found.collect())
    assert got == sorted((i if i is not None else -1, base_spans(t)) for i, t in rows) and "m_email" in found.columns
    assert pii.find(empty).count() == 0


def test_spans_carry_what_stands_around_them(spark, monkeypatch):
    import random

    r = random.Random(12)
    texts = ["".join(r.choice(["7", "7", "é", " ", "ab", "\n", "x" * 45]) for _ in range(r.randrange(0, 60))) for _ in range(120)] + ["", "777", "7" * 3 + "é7"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for block in (1, 2, 5, 256):
        monkeypatch.setattr(pii, "BLOCK", block)
        found = frame.selectExpr("i", "regexp_extract_all(text, '7+', 0) m", "split(text, '7+', -1) p").selectExpr("i", f"{pii._spans('m', 'p')} s")
        for i, spans in found.collect():
            want = [(m.start(), m.end(), m[0], texts[i][max(0, m.start() - 40) : m.start()], texts[i][m.end() : m.end() + 1]) for m in re.finditer("7+", texts[i])]
            assert [tuple(s) for s in spans] == want


def test_pii_work_grows_with_the_spans(spark):
    """Fifty thousand spans in one text take about as much longer than an eighth of them as there are more."""
    import time

    def run(n: int):
        text = " ".join(f"call +1 (906) 555-{k % 10000:04d} or 906-555-{k % 10000:04d}, mail a{k}@site.org;" for k in range(n))
        docs = spark.createDataFrame([(1, text), (2, "phone 906-555-1234")], "doc_id long, text string")
        began = time.perf_counter()
        got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
        return text, got[1], time.perf_counter() - began

    run(10)
    few = run(2_100)[2]
    text, spans, many = run(16_800)
    assert many < 16 * few + 10
    base = [(s.kind, s.start, s.end) for s in spans if s.base]
    assert base == [(k, m.start(), m.end()) for k, p in (("email", r"a\d+@site\.org"), ("phone", r"\+1 \(906\) 555-\d+")) for m in re.finditer(p, text)]
    assert all(s.base or text[s.start : s.end].startswith("906-") for s in spans)


def test_wider_spans_yield_to_base_spans(spark, monkeypatch):
    """Overlaps are found from either side, inside and around, over block borders."""
    import random

    r = random.Random(9)
    rows = []
    for k in range(60):
        cells = sorted((a, a + r.randrange(1, 12), r.random() < 0.4) for a in (r.randrange(200) for _ in range(r.randrange(30))))
        rows.append((k, [("phone", a, b, base, "1,1,1,1,1", []) for a, b, base in cells]))
    schema = "i int, candidates array<struct<kind:string,start:int,end:int,base:boolean,votes:string,features:array<string>>>"
    frame = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(pii, "candidates", lambda documents, **_: documents)
    monkeypatch.setattr(pii, "train", lambda found: {k: 1.0 for k in pii.KINDS})
    for block in (2, 256):
        monkeypatch.setattr(pii, "BLOCK", block)
        for i, spans in pii.find(frame).select("i", "spans").collect():
            own = rows[i][1]
            want = sorted((a, b, base) for _, a, b, base, *_ in own if base or not any(y and x < b and a < z for _, x, z, y, *_ in own))
            assert [(s.start, s.end, s.base) for s in spans] == want


def test_em_tells_reliable_labelers():
    p = pii.em({(1, 1, 1, 0, 1): 100, (0, -1, -1, 0, -1): 100, (1, 1, 0, 0, 1): 50, (0, 1, -1, -1, -1): 30})
    assert p[1, 1, 1, 0, 1] > 0.9 and p[0, -1, -1, 0, -1] < 0.1 and pii.em({}) == {}


def test_pii_learns_which_wider_forms_to_add(spark):
    """Spans that base patterns miss, with and without signs of being personal data."""
    import random

    r = random.Random(3)
    names = "ann bob cleo dan eve finn gus hal ida jon".split()
    sites = "alpha.com beta.org gamma.net delta.de".split()
    area = lambda: f"{r.randrange(200, 999)}"
    number = lambda: f"({area()}) {area()}-{r.randrange(1000, 9999)}"
    rows, wide = [], {}
    for k in range(400):
        filler = sentence(4000 + k, 12)
        if k % 4 == 0:
            text = f"{filler} mail {r.choice(names)}@{r.choice(sites)} or call +1 {number()} today"
        elif k % 4 == 1:
            text = f"{filler} e-mail {r.choice(names)} (at) {r.choice(sites)} please"
            wide[k] = "email"
        elif k % 4 == 2:
            text = f"{filler} phone {number()} now"
            wide[k] = "phone"
        else:
            text = f"{filler} serial x{area()}.{area()}.{r.randrange(1000, 9999)}7z order {r.randrange(10**15, 10**16)}"
        rows.append((k, text))
    found = {x.doc_id: [(s.kind, s.base) for s in x.spans] for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum((kind, False) in found[k] for k, kind in wide.items())
    wrong = sum(any(not base for _, base in found[k]) for k in range(3, 400, 4))
    assert caught >= 0.9 * len(wide) and wrong <= 0.05 * 100


# --- 9 language-model scores


def lm_brute_force(rows: list, good: set, other: set) -> list:
    """Conditional bigram losses with plain counters; rows are chosen by their place."""
    import math
    from collections import Counter

    tokens = lambda t: [w.lower().encode() for w in re.findall("[^\x20\x09-\x0D]+", t or "")] + [None]
    size = len({w for _, t in rows for w in tokens(t)})
    out = []
    for chosen in (good, other):
        single, double = Counter(), Counter()
        for k in chosen:
            found = tokens(rows[k][1])
            single.update(found)
            double.update(zip([None, *found], found))
        n, d, prior = sum(single.values()), lmscore.DISCOUNT, lmscore.PRIOR
        alone = lambda w: (single[w] + d) / (n + d * size)
        chance = lambda u, w: (double[u, w] + prior * alone(w)) / (single[u] + prior)
        words = {w for _, t in rows for w in tokens(t)}
        assert sum(chance(None, w) for w in words) == pytest.approx(1)
        out.append([-sum(math.log(chance(u, w)) for u, w in zip([None, *tokens(t)], tokens(t))) / len(tokens(t)) for _, t in rows])
    return [(i, len(tokens(t)), a, b) for (i, t), a, b in zip(rows, *out)]


@pytest.mark.parametrize("options", [{}, {"part_tokens": 9}])
def test_lm_scores(spark, empty, monkeypatch, options):
    monkeypatch.setattr(lmscore, "SLOTS", 16)
    held = {r.i for r in spark.range(60).selectExpr("id as i").where(lmscore.held_out("i")).collect()}
    rows = [(i, sentence(i % 7, 5 + i % 9) + (" fine Words" if i % 2 else "")) for i in range(60)] + [(61, None), (62, ""), (1, "again fine"), (None, "x y"), (3, sentence(3, 8))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 row", "'p' part", "2 batch").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(31, None), (None, 1), (5, 0)], "doc_id long, quality int")
    slots = dict((-1 if r.i is None else r.i, r.s) for r in frame.selectExpr("doc_id as i", "cast(pmod(xxhash64(doc_id, 'background'), 16) as int) as s").collect())
    good = {k for k, (i, _) in enumerate(rows) if i in set(range(1, 30, 2)) - held}
    rest = [k for k, (i, _) in enumerate(rows) if k not in good and not (i in held and i < 30)]
    length = [len((t or "").split()) + 1 for _, t in rows]
    wanted = sum(length[k] for k in good)
    taken = [{k for k in rest if slots[-1 if rows[k][0] is None else rows[k][0]] < n} for n in range(17)]
    other = min(taken, key=lambda ks: abs(wanted - sum(length[k] for k in ks)))
    assert held & set(range(30)) and 0 < len(other) < len(rest) and abs(wanted - sum(length[k] for k in other)) < 40
    key = lambda r: (-1 if r[0] is None else r[0], *map(float, r[1:]))
    got = sorted(key((r.doc_id, r.n_tokens, r.target_loss, r.background_loss)) for r in lmscore.score(frame, labels, **options).collect())
    want = sorted(key(r) for r in lm_brute_force(rows, good, other))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, rel=1e-9)
    assert lmscore.score(empty, labels).count() == 0
    without = {round(x, 9) for r in lmscore.score(frame, labels.where("false")).collect() for x in (r.target_loss, r.background_loss)}
    assert len(without) == 1


def test_lm_tables_hold_few_rows_in_memory(spark):
    """Rows of a MB each: a writer closes a row group by its bytes, not after a hundred rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lumenfold.llm.scratch import WIDE_ROWS, materialize

    rows = spark.range(40).repartition(1).selectExpr("id", "cast(array_join(transform(sequence(1, 70000), i -> hex(xxhash64(id, i))), '') as binary) as b")
    table = materialize(rows, "lm-wide", wide=True)
    (file,) = table.inputFiles()
    meta = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert meta.num_rows == 40 and max(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)) <= 1.25 * WIDE_ROWS["parquet.block.size"]
    a, b = np.array([3, 2**63, 2**64 - 1], np.uint64), np.array([1, 0, 70_000], np.uint32)
    assert all(x.tolist() == y.tolist() for x, y in zip(lmscore.unpacked(lmscore.packed(a, b), np.uint64, np.uint32), (a, b)))



def test_lm_parts_are_even(spark):
    """A word in every document, many times, reaches its part once a batch."""
    rows = [(k, "the " * 200 + " ".join(f"w{k}x{j}" for j in range(50))) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "cast(1 as tinyint) as kind", "0 as slot").repartition(4)
    batches = lmscore.materialize(lmscore._batches(frame), "lm-test")
    sizes = [r.n for r in lmscore._packets(batches, 256, 1).groupBy("part").agg(F.sum(F.octet_length("codes") / 8).alias("n")).collect()]
    assert len(sizes) == 256 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_lm_ranks_held_out_labels(spark):
    """Two manners of writing with the same words: only what follows what tells them apart."""
    import random

    r = random.Random(6)

    def walk(step: int) -> str:
        at, out = r.randrange(40), []
        for _ in range(60):
            out.append(f"w{at}")
            at = (at + step) % 40 if r.random() < 0.7 else r.randrange(40)
        return " ".join(out)

    rows = [(k, walk(3 if k % 2 else 7)) for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, quality int")
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", lmscore.held_out()).repartition(3)
    got = lmscore.score(frame, labels).join(frame, "doc_id").where("held").collect()
    assert len(got) > 40 and all((r.score < 0) == bool(r.doc_id % 2) for r in got)


def test_lm_word_hashes_do_not_depend_on_chunks(monkeypatch):
    import numpy as np

    parts = [t.encode() for t in ("One two  three", "", "  ONE\ttwo\n", "x" * 300 + " one", "é one", " ", "two")]
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    of = lambda: [(int(h), int(r)) for h, r in zip(*lmscore.word_hashes(data, ends - [len(p) for p in parts], ends))]
    whole = of()
    assert [r for _, r in whole] == [0, 0, 0, 2, 2, 3, 3, 4, 4, 6]
    assert whole[0][0] == whole[3][0] == whole[6][0] == whole[8][0] and whole[1][0] == whole[4][0] == whole[9][0] and len({h for h, _ in whole}) == 5
    monkeypatch.setattr(lmscore, "CHUNK", 7)
    assert of() == whole


def test_long_texts(spark):
    """One text of several megabytes, as one line and as many, beside short ones."""
    one = " ".join(f"x{k * 7919 % 1_000_003}" for k in range(400_000))
    docs = spark.createDataFrame([(1, one), (2, "short text"), (3, one.replace(" ", "\n", 50_000))], "doc_id long, text string")
    assert len(one) > 2 << 20
    assert {r.doc_id: r.n_lines for r in linededup.decide(docs).collect()} == {1: 1, 2: 1, 3: 50_001}
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert {r.doc_id: r.n_tokens for r in lmscore.score(docs, labels).collect()} == {1: 400_001, 2: 3, 3: 400_001}
    assert {r.doc_id: len(r.spans) for r in pii.find(docs).collect()} == {1: 0, 2: 0, 3: 0}
    got = {r.doc_id: r.s for r in toxicity.score(docs, toxicity.train(docs, labels.selectExpr("doc_id", "quality as toxic")), output="s").collect()}
    assert got[1] == got[2] == got[3]


# --- 10 token files


def test_token_files(spark, documents, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_tokenizer())
    files = tokens.write_tokens(documents, f"file://{tmp_path}/ids")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(spark, files).collect()}
    start, want = 0, {}
    for i, t in sorted(texts().items()):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert got == want
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(spark, files, [7, 3]).collect()} == {k: want[k] for k in (3, 7)}
    assert tokens.read_tokens(spark, tokens.write_tokens(odd)).count() == 5 and tokens.read_tokens(spark, tokens.write_tokens(empty)).count() == 0


@pytest.mark.parametrize("pieces", [1_000_000, 40])
def test_encoder_equals_the_library(monkeypatch, pieces):
    import random
    from array import array

    monkeypatch.setattr(tokens, "TABLE_PIECES", pieces)
    e = tokens.Encoder(tokens.default_tokenizer())
    r = random.Random(3)
    letters = [*"ab é²½٣'s.,;:!? \n\t\x1c_19|—ß́中", "don't ", "  ", "x. ", "l'été, ", "<|endoftext|>"]
    for _ in range(400):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        assert e.encode([t])[0] == array("I", e.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()


def test_damaged_frames_are_noticed(tmp_path):
    import io

    out = io.BytesIO()
    writer = tokens.FrameWriter(out)
    for k in range(5):
        writer.add(k, struct.pack("<3I", k, k, 0) * 40)
    writer.close()
    data = bytearray(out.getvalue())
    reader = tokens.FrameReader(io.BytesIO(bytes(data)), len(data))
    assert reader.find(3) == [struct.pack("<3I", 3, 3, 0) * 40] and len(reader) == 5
    data[int(reader.offsets[2]) + 8] ^= 1
    with pytest.raises(Exception):
        list(tokens.FrameReader(io.BytesIO(bytes(data)), len(data)).frames(0, 5))


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in registry.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_new_pieces_are_encoded_many_at_once(monkeypatch):
    """The library gets one text for many new pieces, and the ids are those of each piece by itself."""
    e, calls = tokens.Encoder(tokens.default_tokenizer()), []
    library = e._library
    monkeypatch.setattr(e, "_library", lambda texts: calls.append(len(texts)) or library(texts))
    pieces = [f"{blank}{mark}{k}é{end}" for k in range(300) for blank in ("", " ") for mark in ("w", "'s", "(", "'ll7") for end in ("", ".,", "!?'")] + ["\n", "\t", "  ", "\u2003", "a\nb", " \n\n", "\x1c"]
    got = e._pieces(pieces)
    assert sum(calls) < len(pieces) / 50
    assert got == library(pieces)
