"""Vector codes, importance resampling and SimHash groups against plain Python and SQL, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from tracewell.llm import importance, simhash, vector_codes
from tracewell.llm.common import attach

WORDS = ["the", "of", "Anna", "thing", "réé", "ÉT", "x1", "über", "İz", "k", "lorem", "don't", "日本語"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


ODD = ["", " ", "\n\n", "a", "A b", None, "a b c", "x\x0by\x1cz\x85w v", "!? --", prose(30, 1), prose(30, 1).upper(), "word " * 30000]
CLASHING = "doc_id long, text string, r long, word string, bucket int, fp long, part int, node string"


def frame(spark, rows, schema=CLASHING):
    return attach(spark).createDataFrame([(i, t, 1, "w", 2, 3, 4, "n") for i, t in rows], schema)


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(ODD)) + [(100 + i, prose(60, i)) for i in range(40)] + [(200, prose(60, 3)), (201, prose(60, 3)), (201, prose(60, 3)), (None, prose(60, 4)), (None, None)]
    for i in range(12):
        w = prose(300, 7).split()
        w[20 * i] = "changed"
        out.append((300 + i, " ".join(w)))
    return out


def plain_words(text, chars):
    return re.findall(chars, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_resample(rows, target, orders=(1, 1)):
    grams = lambda t: [" ".join(w[i : i + n]) for w in [plain_words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")] for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = (Counter(bucket(g) for x in texts for g in grams(x)) for texts in ([t for _, t in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for i, text in rows:
        g = [gain(bucket(x)) for x in grams(text)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        words = len(plain_words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    wanted = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(wanted[: 10 * len(wanted) // 100], 1):
        r[4] = k
    return sorted((r[:5] for r in out), key=str)


TARGET = ["the x1 thing7 lorem3", None, "", "über1 of2 of2 über1 of2"]


@pytest.mark.parametrize("orders", [(1, 1), (1, 3), (2, 2)])
def test_importance_against_plain_python(spark, rows, orders, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 50)
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, r int")
    got = importance.resample(frame(spark, rows), target, orders=orders)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted((list(r) for r in got.collect()), key=str) == plain_resample(rows, TARGET, orders)


def test_importance_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(frame(spark, []), none).collect() == []
    assert [tuple(r)[:3] for r in importance.resample(frame(spark, [(1, None), (2, "")]), none).collect()] == [(1, 0, 0), (2, 0, 0)]


def test_importance_ranks_over_many_parts(spark):
    rows = [(i % 997, prose(25, i % 5)) for i in range(3000)]
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resample(frame(spark, rows).repartition(7), target)
    drawn = sorted((r.rank, -r.score, r.doc_id) for r in got.where("rank IS NOT NULL").collect())
    assert [r[0] for r in drawn] == list(range(1, 301))
    assert [r[1:] for r in drawn] == sorted((-r.score, r.doc_id) for r in got.collect())[:300]


def test_importance_sql(spark, rows, tmp_path):
    con = duckdb.connect()
    ids = [(i, t) for i, t in rows if i is not None and i != 201]
    docs, target = pd.DataFrame(ids, columns=["doc_id", "text"]), pd.DataFrame({"text": TARGET})
    con.register("documents", docs)
    con.register("benchmark", target)
    got = sorted(([None if pd.isna(x) else int(x) for x in r] for r in con.execute(importance.oracle()).fetchall()), key=str)
    assert got == plain_resample(ids, TARGET)


def plain_fingerprint(text):
    w = plain_words(text, r"[^\x20\x09-\x0D]+")
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    top = {f: f for f in prints}

    def of(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in top:
        for b in top:
            if (a ^ b).bit_count() <= 3:
                low, high = sorted((of(a), of(b)))
                top[high] = low
    return {f: of(f) for f in top}


def test_simhash_against_plain_python(spark, rows):
    got = simhash.simhash_groups(frame(spark, rows))
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    group = plain_groups([f for _, f in prints])
    least = defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[group[f]].append(i)
    want = [(i, f"{f:016x}", min(least[group[f]], default=None)) for i, f in prints]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert len({w[2] for w in want}) < len({w[1] for w in want})


def test_simhash_pieces_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 40)
    for text in (prose(300, 5), "a b " + "x" * 500 + " c d " + "y" * 90, " " * 200, "A  \n b" + " " * 200):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.simhash_groups(frame(spark, [])).collect() == []
    assert [tuple(r) for r in simhash.simhash_groups(frame(spark, [(None, None)])).collect()] == [(None, "0" * 16, None)]


@pytest.mark.parametrize(("tree", "most"), [(4096, 1 << 26), (16, 1 << 26), (16, 0)])
def test_simhash_links_of_dense_shards(spark, monkeypatch, tree, most):
    """Dense balls, whose shards have one tree, several that are broadcast, and several that are dealt out."""
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = set(base) | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(500):
        x = r.choice(sorted(prints) if r.random() < 0.3 else base)
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    monkeypatch.setattr(simhash, "TREE", tree)
    monkeypatch.setattr(simhash, "MOST_TREE_BYTES", most)
    monkeypatch.setattr(simhash, "VISITS", 3000)
    attach(spark)
    links = simhash.links_of(spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long").repartition(5), len(prints)).collect()
    group = plain_groups(sorted(prints))
    top = {simhash.signed(f): simhash.signed(f) for f in prints}

    def of(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        assert group[a % (1 << 64)] == group[b % (1 << 64)]
        top[of(a)] = of(b)
    assert len({of(x) for x in top}) == len(set(group.values()))


@pytest.mark.parametrize("distinct", [1, 10**6, 10**8, 10**10, 10**12])
def test_simhash_shards_miss_no_pair(distinct):
    r = random.Random(distinct)
    masks = simhash.masks(distinct)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for _ in range(3):
            b ^= 1 << r.randrange(64)
        assert any(a & m == b & m for m in masks)
    assert len(masks) <= 35


def vectors(n, seed, dims=32, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    return [[float(np.float32(x)) for x in centres[i % 6] * spread + r.normal(size=dims) * 0.2] for i in range(n)]


VECTORS = "vec_id long, embedding array<float>, label int, codes string, n int"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, lab) for i, v, lab in rows if v and len(v) == 32 and all(x is not None and math.isfinite(x) and abs(x) < 1 << 18 for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    cut = [[w[p * 2 : p * 2 + 2] for p in range(parts)] for w in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda p: [min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e)) for c in cut]
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c, e in zip(cut, assign(p), strict=True):
                own[e].append(c[p])
            for e, members in own.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    codes = list(zip(*[assign(p) for p in range(parts)], strict=True))
    error = [sum(dist(c[p], books[p][e]) for p, e in enumerate(code)) for c, code in zip(cut, codes, strict=True)]
    by_label = defaultdict(int)
    for (_, _, lab), e in zip(kept, error, strict=True):
        by_label[lab] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(str((i, "".join(f"{e:02x}" for e in code), err, by_label[lab], sha)) for (i, _, lab), code, err in zip(kept, codes, error, strict=True))


def run_codes(frame_):
    codes, books = vector_codes.vector_codes(frame_)
    return sorted(str((r.vec_id, r.code, r.error, r.label_error, vector_codes.books_sha256(books))) for r in vector_codes.with_label_error(codes).collect())


def test_vector_codes_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 37)
    good = vectors(300, 1)
    rows = [(i, v, None if i % 7 == 0 else i % 3) for i, v in enumerate(good)]
    rows += [(7, good[3], 1), (7, good[9], 1), (None, good[5], 2), (None, good[5], None), (2, None, 1), (1, [], 1), (0, [1.0] * 16, 1), (0, [1.0] * 33, 1)]
    rows += [(3, [None, *good[3][1:]], 1), (3, [math.nan, *good[3][1:]], 1), (3, [math.inf, *good[3][1:]], 1), (3, [1e30, *good[3][1:]], 1)]
    rows = [r for r in rows if r[1] is None or len(r[1]) != 16]  # else the smallest id would set another length
    rows += [(1000 + i, [0.0] * 32, 5) for i in range(30)]  # ties and repeats
    frame_ = attach(spark).createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    assert run_codes(frame_) == plain_codes(rows)


def test_few_vectors_and_none(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(5, 2))]
    assert run_codes(attach(spark).createDataFrame([(*r, "x", 1) for r in rows], VECTORS)) == plain_codes(rows)
    one = [(1, [0.5] * 32, None)]
    assert run_codes(spark.createDataFrame([(*r, "x", 1) for r in one], VECTORS)) == plain_codes(one)
    assert run_codes(spark.createDataFrame([(1, None, 2, "x", 1)], VECTORS)) == []
    assert run_codes(spark.createDataFrame([], VECTORS)) == []


def test_only_violated_parts_are_looked_at(spark):
    """Groups that lie far apart: entries settle, and a round without drift pops parts of equal distances alone."""
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.repeat(r.integers(0, 64, 16) * 3.0, 2)], 0, "x", 1) for i in range(2000)]
    kept = attach(spark).createDataFrame(rows, VECTORS).selectExpr("vec_id", "label", "CAST(embedding AS array<double>) AS embedding")
    books = np.stack([np.repeat(np.arange(64) * 768, 2).reshape(64, 2)] * 16)
    blocks = vector_codes.start(kept, books).where("vec_ids IS NOT NULL").cache()
    assert vector_codes.again(blocks, books, np.zeros((16, 64))).selectExpr("sum(popped)").first()[0] == 0
    moved = books.copy()
    moved[3, 5] += 1
    far = np.array([vector_codes.drift(a, b) for a, b in zip(books, moved, strict=True)])
    assert vector_codes.again(blocks, moved, far).selectExpr("sum(popped)").first()[0] == 0  # drift smaller than the slack
    far[3, 5] = 1e6
    with_five = sum(round(row[1][6] / 3) == 5 for row in rows)
    assert vector_codes.again(blocks, moved, far).selectExpr("sum(popped)").first()[0] == with_five


def test_vector_codes_sql(spark):
    rows = [(i, v, None if i % 7 == 0 else i % 3) for i, v in enumerate(vectors(150, 6))]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [*rows, (3, None, 1), (4, [math.nan] * 32, 1), (5, [math.inf] * 32, 1)])
    assert sorted(map(str, con.execute(vector_codes.oracle()).fetchall())) == plain_codes(rows)
