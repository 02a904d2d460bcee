"""Periodic runs against a version that tries every period at every place."""

import hashlib
import random
import re
import time
import zlib

import pytest

from lumenfold.llm import periodic, registry


def brute(words, least=6, exponent=4) -> list:
    """(start, length, period): maximal stretches in which words a period apart agree, of which it is the smallest."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            stretch = words[i : i + length]
            if j > i and length >= max(least, exponent * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sample(seed: int) -> list:
    r = random.Random(seed)
    n, letters = r.randrange(0, 70), r.choice([1, 2, 2, 3, 5])
    words = [bytes([97 + r.randrange(letters)]) for _ in range(n)]
    if n and r.random() < 0.6:
        p, a = r.randrange(1, 9), r.randrange(n)
        words = [words[a + (i - a) % p] if i >= a and a + (i - a) % p < n else words[i] for i in range(n)]
    return words


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (3, 2), (8, 3), (4, 5)])
def test_runs_of_random_words(least, exponent):
    batch = [sample(seed) for seed in range(400)]
    got = periodic.analyse([b" ".join(w) for w in batch], least, exponent)
    for words, (n, runs, kept) in zip(batch, got):
        want = brute(words, least, exponent)
        gone = {k for s, length, q in want for k in range(s + q, s + length)}
        assert (n, runs) == (len(words), want)
        assert kept == b" ".join(w for k, w in enumerate(words) if k not in gone)


def test_automaton_has_all_end_positions():
    words = [b"abracadabra"[k : k + 1] for k in range(11)]
    length, link, own = periodic.states(words)
    ends = {k: {e} if e >= 0 else set() for k, e in enumerate(own)}
    for k in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        ends[link[k]] |= ends[k]
    parts = {tuple(sorted(e for e in range(10 + 1) if tuple(words[e - n + 1 : e + 1]) == tuple(words[s : s + n]) and e >= n - 1)) for n in range(1, 12) for s in range(12 - n)}
    assert {tuple(sorted(e)) for k, e in ends.items() if k} == parts


def test_long_runs_take_no_square_time():
    began = time.perf_counter()
    one, many = [b"w"] * 60_000, [b"%d" % (k % 97) for k in range(60_000)]
    assert periodic.runs_of(one) == [(0, 60_000, 1)] and periodic.runs_of(many) == [(0, 60_000, 97)]
    assert time.perf_counter() - began < 30


def test_plain_prose_gets_no_automaton(monkeypatch):
    r = random.Random(4)
    text = " ".join(f"w{r.randrange(300)}" for _ in range(20_000)) + " x y" * 5 + " " + " ".join(f"w{r.randrange(300)}" for _ in range(500))
    seen = []
    monkeypatch.setattr(periodic, "runs_of", lambda words, *_: seen.append(len(words)) or [])
    periodic.analyse([text.encode()])
    assert 10 <= sum(seen) < 100


def test_columns_pass_and_odd_rows_are_defined(spark):
    rows = [(1, None, "k", 5), (1, "", "k", 6), (None, " \t\n", "k", 7), (2, "a b " * 6, "k", 8), (2, "a b " * 6, "k", 8), (3, "a b " * 7, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3)
    found = periodic.find_runs(docs)
    assert found.columns == ["doc_id", "runs", "n_words", "n_words_", "runs_", "collapsed"]
    got = sorted((r.n_words, r.n_words_, [tuple(x) for x in r.runs_], r.collapsed) for r in found.collect())
    assert got == [(5, 0, [], ""), (6, 0, [], ""), (7, 0, [], ""), (8, 12, [(0, 12, 2)], "a b"), (8, 12, [(0, 12, 2)], "a b"), (9, 7, [(0, 7, 1)], "a b")]
    back = periodic.collapse(docs)
    assert back.columns == docs.columns and sorted((r.n_words, r.text) for r in back.collect() if r.text is None) == [(5, None)]
    assert periodic.find_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, min_exponent=1)


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    texts = {k: " ".join(w.decode() for w in sample(k)) for k in range(150)}
    texts |= {k: " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(1, 300))) for k in range(150, 260)}
    texts |= {-5: None, -6: "", -7: " \n", -8: "été " * 9, 900: "a  b\n" * 8}
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.asDict() for x in registry.QUERIES["op12_runs"](spark, str(tmp_path)).collect()}
    altered = 0
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            altered += 1
        runs = brute(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert got[i] == {
            "doc_id": i,
            "n_runs": len(runs),
            "start": best[0],
            "length": best[1],
            "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest(),
        }
    assert altered > 10 and sum(x["n_runs"] > 0 for x in got.values()) > 40
