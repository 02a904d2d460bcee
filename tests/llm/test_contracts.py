"""Each registered query over a small folder of tables against an independent plain-Python version of its contract."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest

from lumenfold.llm import registry

VOCABULARY = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "to", "vu", "ze") for b in ("ban", "dor", "fel", "gim", "hox", "jat", "kup", "lys", "mor", "nev")]


def text_of(r: random.Random, n: int) -> str:
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def make_documents() -> list:
    r = random.Random(31)
    passages = [text_of(r, 40) for _ in range(4)]
    rows = []
    for k in range(90):
        t = text_of(r, r.randrange(3, 120))
        if k % 5 == 0:
            t += " " + passages[k % 4]
        if k % 7 == 0:
            t += " you DUNCE and blockhead " + text_of(r, 5)
        if k % 11 == 0:
            t += " mail joe@site.org, call +1 (906) 555-7738 or 10.1.2.3 card 4111 1111 1111 1111"
        if k % 13 == 0 and rows:
            t = rows[-1][1]
        if k % 17 == 0 and len(rows) > 3:
            words = rows[-3][1].split()
            words[len(words) // 2] = "changed"
            t = " ".join(words)
        rows.append((k * 3 + 1, t))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one Two"), (1004, "ONE two"), (1005, "é" * 130), (1006, text_of(r, 30) + "\n" + passages[1]), (1007, text_of(r, 4000) + " " + passages[2])]
    return [(i, t, ["en", "fr"][i % 2], None if i == 7 else f"s{i % 4}" if i % 3 else "hot", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def tables():
    r = random.Random(5)
    docs = make_documents()
    labels = [(i, int("ka" in (t or "")), int("DUNCE" in (t or ""))) for i, t, *_ in docs if i % 4]
    source = docs[10][1].split()
    items = [(1, " ".join(source[:20])), (2, docs[20][1].upper()), (3, "one two"), (4, None), (5, "..."), (12, text_of(r, 30))]
    vectors = [(k, [round(r.gauss(0, 1), 3) for _ in range(8)]) for k in range(320)] + [(400, None), (500, [float("nan")] * 8)]
    return {"documents": docs, "labels": labels, "benchmark": items, "embeddings": vectors}


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>"}
    for name, schema in schemas.items():
        spark.createDataFrame(tables[name], schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


def rows_of(spark, folder, name) -> dict:
    found = registry.QUERIES[name](spark, folder)
    key = found.columns[0]
    out = {r[key]: r.asDict() for r in found.collect()}
    return out


def texts(tables) -> dict:
    return {i: t for i, t, *_ in tables["documents"]}


def lowered(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_op1_takes_words_near_the_targets(spark, folder, tables):
    got = rows_of(spark, folder, "op1_mix")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts(tables).items()}
    source = {i: s for i, _, _, s, _ in tables["documents"]}
    assert {i: r["size"] for i, r in got.items()} == size
    for s in set(source.values()):
        mine = [r for i, r in got.items() if source[i] == s]
        assert {r["source_size"] for r in mine} == {sum(size[i] for i in size if source[i] == s)}
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(size[i] for i in size if source[i] == s) / 2 + 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got.values())


def test_op2_says_which_lines_go(spark, folder, tables):
    got = rows_of(spark, folder, "op2_line_dedup")
    first, gone = {}, {}
    for i, t in sorted(texts(tables).items()):
        for k, line in enumerate([] if t is None else t.split("\n")):
            norm = re.sub(r"\s+", " ", line).strip().lower()
            if norm and first.setdefault(norm, (i, k)) != (i, k):
                gone.setdefault(i, set()).add(k)
    for i, t in texts(tables).items():
        removed = {int(x) for x in got[i]["removed_lines"].split(",") if x}
        assert got[i]["n_lines"] == (0 if t is None else len(t.split("\n"))) and got[i]["n_kept"] == got[i]["n_lines"] - len(removed)
        assert gone.get(i, set()) <= removed  # exact copies go; near ones may go too
    near = {i for i, r in got.items() if r["removed_lines"]} - set(gone)
    assert near and len(near) < 20


def toxicity_by_hand(docs: dict, labels: list) -> dict:
    """Ratios, selection and regression written out with dictionaries and dense matrices."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0

    def features(t):
        data = b" " + b" ".join((t or "").lower().encode().split()) + b" "
        grams = {(n, data[k : k + n]) for n in (3, 4, 5, 6) for k in range(len(data) - n + 1)}
        return {((int.from_bytes(g, "little") | n << 56) * 0x9E3779B97F4A7C15 % 2**64) >> 42 for n, g in grams}

    train = {i: y for i, _, y in labels if not fold(i)}
    sets = {i: features(t) for i, t in docs.items()}
    n1, n0 = sum(train.values()), len(train) - sum(train.values())
    counts = {}
    for i, y in train.items():
        for f in sets[i]:
            counts.setdefault(f, [0, 0])[y] += 1

    def g2(c0, c1):
        total = 0.0
        for seen, expected in ((c1, (c0 + c1) * n1 / (n0 + n1)), (c0, (c0 + c1) * n0 / (n0 + n1)), (n1 - c1, (n0 + n1 - c0 - c1) * n1 / (n0 + n1)), (n0 - c0, (n0 + n1 - c0 - c1) * n0 / (n0 + n1))):
            total += 2 * seen * math.log(seen / expected) if seen else 0.0
        return total

    kept = sorted(f for f, (c0, c1) in counts.items() if g2(c0, c1) >= 10.8)
    ratio = np.array([math.log((counts[f][1] + 1) / (n1 + 2)) - math.log((counts[f][0] + 1) / (n0 + 2)) for f in kept])
    x = np.array([[f in sets[i] for f in kept] for i in train], float) * ratio
    y = np.array(list(train.values()), float)
    w, b, rate = np.zeros(len(kept)), math.log((n1 + 1) / (n0 + 2)), 4 * len(y) / (np.linalg.norm(x, 2) ** 2 + len(y))
    for _ in range(6000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w - rate * (x.T @ (p - y) / len(y) + 1e-3 * w), b - rate * (p - y).mean()
    return {i: (fold(i), 1 / (1 + math.exp(-(sum(w[k] * ratio[k] for k, f in enumerate(kept) if f in s) + b)))) for i, s in sets.items()}


def test_op3_equals_the_classifier_written_out(spark, folder, tables):
    got = rows_of(spark, folder, "op3_toxicity")
    want = toxicity_by_hand(texts(tables), tables["labels"])
    assert set(got) == set(want)
    for i, (held, score) in want.items():
        assert got[i]["held_out"] == held and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
        assert got[i]["score"] == pytest.approx(score, abs=0.02)
    right = [got[i]["predicted"] == int("DUNCE" in (t or "")) for i, t in texts(tables).items() if got[i]["held_out"]]
    assert len(right) >= 10 and sum(right) == len(right)


def test_op4_finds_every_window(spark, folder, tables):
    got = rows_of(spark, folder, "op4_decontaminate")
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t).encode())
    windows = [(item, tuple(ws[k : k + 13])) for item, t in tables["benchmark"] for ws in [words(t)] for k in range(max(1, len(ws) - 12)) if ws]
    for i, t in texts(tables).items():
        own, hit, items = words(t), set(), set()
        for item, window in windows:
            for k in range(len(own) - len(window) + 1):
                if tuple(own[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    items.add(str(item))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(own), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(own))
    assert any(r["contaminated"] for r in got.values())


def test_op5_removes_what_starts_earlier(spark, folder, tables):
    got, seen = rows_of(spark, folder, "op5_repeats"), set()
    for i, t in sorted(texts(tables).items()):
        data = (t or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(data[k : k + 100])
        runs = len(re.findall("1+", "".join("01"[g] for g in gone)))
        kept = hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), sum(gone), runs, kept)
    assert sum(r["n_spans"] for r in got.values()) > 10


def test_op6_ranks_all_candidates(spark, folder, tables):
    found = [tuple(r) for r in registry.QUERIES["op6_topk"](spark, folder).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]
    fine = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in tables["embeddings"] if v and not math.isnan(v[0])}
    want = []
    for q in sorted(i for i in fine if i % 100 == 0):
        best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q)[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert found == want


def test_op7_links_and_keeps(spark, folder, tables):
    got = rows_of(spark, folder, "op7_neardup")
    sets = {}
    for i, t in texts(tables).items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[i] = {tuple(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))} if ws else set()
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    for i, r in got.items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), label[i], label[i] == i)
    assert sum(not r["kept"] for r in got.values()) >= 5


def test_op8_keeps_base_spans_and_adds_to_them(spark, folder, tables):
    got = rows_of(spark, folder, "op8_pii")

    def luhn(d):
        return sum((x * 2 - 9 if x > 4 else x * 2) if k % 2 else x for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    for i, t in texts(tables).items():
        base = [f"{k}:{m.start()}:{m.end()}" for k, (p, fine) in kinds.items() for m in re.finditer(p, t or "") if fine(m)]
        r = got[i]
        spans = [x for x in r["spans"].split(",") if x]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(spans)
        assert [r[f"n_{k}"] for k in kinds] == [sum(x.startswith(f"{k}:") for x in spans) for k in kinds]
        order = [(list(kinds).index(x.split(":")[0]), int(x.split(":")[1])) for x in spans]
        assert order == sorted(order)
    assert sum(r["n_email"] for r in got.values()) >= 8


def test_op9_scores_every_document(spark, folder, tables):
    got = rows_of(spark, folder, "op9_lm_score")
    for i, t in texts(tables).items():
        assert got[i]["n_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
        assert got[i]["score"] == pytest.approx(got[i]["target_loss"] - got[i]["background_loss"])


def test_op10_reads_back_every_id(spark, folder, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = rows_of(spark, folder, "op10_tokens"), 0
    for i, t in sorted(texts(tables).items()):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
