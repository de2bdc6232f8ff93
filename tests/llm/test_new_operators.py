"""Line-labelled quality, conversation trie and embedding whitening against brute force, enumeration and held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relindex.llm import line_quality as lq
from relindex.llm import queries as Q
from relindex.llm import whitening as wh
from relindex.llm import zfast_trie as zt

CLASH = ["n", "x", "v", "key", "score", "good", "c", "d", "a", "b", "component", "part", "size", "__text", "depth"]


def clash(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# --- 11 ------------------------------------------------------------------------------------------

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lines = np.array([3, 1, 6, 2, 6, 5])
    score = rng.normal(size=lines.sum()) * 2
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    p, pairs, first = lq.Chains(lines).marginals(score, trans, start)
    at, all_pairs, all_first = 0, np.zeros((2, 2)), np.zeros(2)
    for n in lines:
        s = score[at:at + n]
        total, bad = 0.0, np.zeros(n)
        two, one = np.zeros((2, 2)), np.zeros(2)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(start[y[0]] + sum(s[k] * y[k] for k in range(n)) + sum(trans[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            bad += w * np.array(y)
            one[y[0]] += w
            for k in range(1, n):
                two[y[k - 1], y[k]] += w
        assert p[at:at + n] == pytest.approx(bad / total)
        all_pairs += two / total
        all_first += one / total
        at += n
    assert pairs == pytest.approx(all_pairs) and first == pytest.approx(all_first)


def test_line_features_see_neighbours_and_place():
    rows = ["one two\nTHREE!! FOUR!!\none two", None, "", "x x x x", "é\n"]
    x, size, lines = lq.line_features(rows)
    assert lines.tolist() == [3, 1, 1, 1, 2] and size.tolist() == [7, 14, 7, 0, 0, 7, 2, 0]
    own = x[:, :lq.OWN]
    assert (x[0, lq.OWN:2 * lq.OWN] == 0).all() and (x[1, lq.OWN:2 * lq.OWN] == own[0]).all() and (x[1, 2 * lq.OWN:3 * lq.OWN] == own[2]).all()
    assert (x[2, 2 * lq.OWN:3 * lq.OWN] == 0).all() and (x[3, lq.OWN:3 * lq.OWN] == 0).all()
    for k, r in enumerate(rows):  # alone or among others
        alone = lq.line_features([r])[0]
        assert (alone == x[lines[:k].sum():lines[:k + 1].sum()]).all()


def quality_rows(n=160, seed=3):
    """Good prose, and documents in which a part of the lines is shouted, ruled or repeated."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8)))
    line = lambda: (" ".join(word() for _ in range(rng.randint(4, 14))) + ".").capitalize()
    out = []
    for i in range(n):
        text, good = [line() for _ in range(rng.randint(1, 9))], i % 4 != 0
        if not good:
            junk = {0: lambda: " ".join(word().upper() + "!!" for _ in range(9)), 1: lambda: " | ".join(word() for _ in range(9)),
                    2: lambda: " ".join([word()] * 20)}[i // 4 % 3]
            text = text[:1] + [junk() for _ in range(len(text) + 2)]
        out.append((i, "\n".join(text), int(good)))
    return out


@pytest.fixture(scope="module")
def quality(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(None, 0), (500, None), (501, 7)], "doc_id long, quality int")
    return rows, docs, labels


def test_held_out_quality(spark, quality):
    rows, docs, labels = quality
    learnt = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True))
    field = lq.train(docs.where(learnt), labels.where(learnt))
    r = {x["doc_id"]: x for x in lq.assess(clash(docs), field).collect()}
    held = [(i, t, g) for i, t, g in rows if i % 3 == 1]
    assert sum((r[i]["score"] >= 0.5) == (g == 1) for i, _, g in held) >= 0.97 * len(held)
    assert all(r[i]["n_lines"] == t.count("\n") + 1 for i, t, _ in rows)
    mixed = [i for i, _, g in rows if not g]
    assert any(0 < r[i]["n_bad"] < r[i]["n_lines"] for i in mixed)  # lines of one document may differ
    again = lq.train(docs.repartition(7).where(learnt), labels.where(learnt))
    assert (again.w == field.w).all() and again.curve == field.curve
    # the length-weighted mean of the marginals, through the curve
    i, t, _ = rows[0]
    x, size, lines = lq.line_features([t])
    bad = field.bad_lines(x, lines)
    good = float(((1 - bad) * np.maximum(size, 1)).sum() / np.maximum(size, 1).sum())
    a, b = field.curve
    assert r[i]["score"] == pytest.approx(1 / (1 + math.exp(-(a * math.log(good / (1 - good)) + b))), abs=1e-3)


def test_quality_odd_rows(spark, quality):
    rows, docs, labels = quality
    field = lq.train(docs, labels, rows=20)
    odd = spark.createDataFrame([(None, None), (None, "a b"), (1, ""), (2, "\n\n\n"), (2, "\n\n\n"), (3, "word " * 200_000), (4, "line one\n" * 30_000)],
                                "doc_id long, text string")
    got = lq.assess(clash(odd), field).collect()
    assert len(got) == 7 and all(0 <= x["score"] <= 1 for x in got)
    assert [x["n_lines"] for x in got if x["doc_id"] == 4] == [30_001]
    same = [x["score"] for x in got if x["doc_id"] == 2]
    assert same[0] == same[1]
    assert lq.assess(odd.where("false"), field).count() == 0
    assert lq.train(docs, labels.where("false")) is None
    assert {x["score"] for x in lq.assess(odd, None).collect()} == {0.5}
    one = lq.train(docs, labels.where("quality = 1"))  # a single label
    assert all(x["score"] > 0.5 for x in lq.assess(docs, one).collect())
    torn = labels.unionByName(labels.where("doc_id < 8").withColumn("quality", 1 - F.col("quality")))
    assert lq.sample(docs, torn).where("text IS NOT NULL").count() == len(rows) - 8  # contradicting labels are left out


# --- 12 ------------------------------------------------------------------------------------------

def trie_brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    for t in convs.values():
        t.sort()
    seq = {}
    for c, t in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq[c] = [(r, x) for _, _, r, x in convs.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:]]
    nodes = {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids, leaves, saved = ({k: 0 for k in nodes} for _ in range(3))
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, m in nodes.items():
        w = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += w
            leaves[k[:d]] += kids[k] == 0
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seq[c]) == len(k)))).encode()).hexdigest()) for k, m in nodes.items()), key=repr)


def trie_rows(kind):
    rng = random.Random(1)
    if kind == "random":  # nulls, negative ids, ties, repeats, turns that are null
        return [(rng.choice([None, *range(-40, 200)]), rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice([None, "u"]), rng.choice(["", None, "a b", "a", "c d e"]))
                for _ in range(700)]
    if kind == "deep":  # conversations that leave a long common line at many places
        out = []
        for c in range(150):
            n = rng.choice([1, 2, 5, 9, 17, 30])
            cut = rng.randrange(n + 1)
            out += [(c, i, "u", "x y" if i < cut else rng.choice(["p", "q q"])) for i in range(n)]
        return out
    if kind == "copies":  # a large group of copies, one conversation with most of the turns
        return [(7 * c, i, "u", f"w{i}") for c in range(120) for i in range(3)] + [(5, i, "u", f"w{i}") for i in range(500)]
    return {"empty": [], "one": [(3, None, None, None)], "turnless": [(1, 1, "a", "b"), (2, None, None, None)]}[kind]


@pytest.mark.parametrize("kind", ["random", "deep", "copies", "empty", "one", "turnless"])
def test_conversation_trie(spark, kind, monkeypatch):
    for name, value in (("HOT_ROWS", 10), ("HOT_SHARE", 50), ("BLOCK", 4), ("ENDS_ROWS", 3)):
        monkeypatch.setattr(zt, name, value)
    rows = trie_rows(kind)
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((tuple(r) for r in zt.conversation_trie(df).collect()), key=repr) == trie_brute(rows)


def test_two_fattest(spark):
    rows = [(lo, hi) for lo in range(0, 20) for hi in range(lo + 1, 40)]
    got = spark.createDataFrame(rows, "lo long, hi long").select("lo", "hi", zt.two_fattest("lo", "hi").alias("f")).collect()
    for r in got:
        assert r["f"] == max(range(r["lo"] + 1, r["hi"] + 1), key=lambda n: n & -n)


# --- 13 ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("case", ["random", "equal", "zeros", "low rank", "huge", "tiny"])
def test_rank_one_update(case):
    rng = np.random.default_rng(7)
    n = 12
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    d = np.sort(rng.random(n)) * 5
    v = rng.normal(size=n)
    if case == "equal":
        d[3:8] = d[3]
    if case == "zeros":
        v = q[:, :4] @ rng.normal(size=4)
    if case == "low rank":
        d[:9] = 0
    if case == "huge":
        d *= 1e12
    if case == "tiny":
        v *= 1e-9
    want = q @ np.diag(d) @ q.T + 2.5 * np.outer(v, v)
    e, u = wh.rank_one(d, q, v, 2.5)
    size = np.abs(want).max()
    assert np.abs(u @ np.diag(e) @ u.T - want).max() < 1e-12 * size and np.abs(u.T @ u - np.eye(n)).max() < 1e-13
    assert (np.diff(e) >= 0).all() and e == pytest.approx(np.linalg.eigvalsh(want), abs=1e-12 * size)


def test_spectra_combine():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 9)) @ rng.normal(size=(9, 9)) + 50
    x[:, 4] = 3.0
    parts = []
    for piece in (x[:1], x[1:40], x[40:40], x[40:]):
        s = wh.Spectrum(9)
        for r in piece:
            s.add(r)
        parts.append(s)
    total = wh.Spectrum(9)
    for s in parts:
        total.combine(s)
    want = (x - x.mean(0)).T @ (x - x.mean(0))
    assert total.n == 300 and total.mean == pytest.approx(x.mean(0))
    assert np.abs(total.q @ np.diag(total.d) @ total.q.T - want).max() < 1e-9 * np.abs(want).max()


def whiten_brute(vectors, keep):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:keep], u[:, ::-1][:, :keep]
    return [int(((n * r.astype(object) - s) ** 2).sum()) for r in x], c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    good = [(k if k % 7 else None, (rng.normal(size=6) * [1, 2, 3, 4, 5, 6]).tolist()) for k in range(200)]
    good += good[:3]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (904, [1.0, 2.0]), (905, [])]
    df = clash(spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").repartition(5))
    r = wh.whiten(df, components=4).collect()
    dev, white, share = whiten_brute([v for _, v in good], 4)
    assert len(r) == 4 * len(good) and {x["n"] for x in r} == {203} and max(x["identity_error"] for x in r) < 1e-9
    key = lambda k: math.inf if k is None else k
    for c in range(1, 5):
        mine = sorted((key(x["vec_id"]), int(x["deviation"]), x["whitened"]) for x in r if x["component"] == c)
        sign = 1 if abs(sum(abs(m[2]) for m in mine)) and np.allclose(sorted(m[2] for m in mine), sorted(white[:, c - 1]), atol=1e-8) else -1
        want = sorted((key(k), dev[i], sign * white[i, c - 1]) for i, (k, _) in enumerate(good))
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        assert [m[2] for m in mine] == pytest.approx([w[2] for w in want], abs=1e-8)
        assert {round(x["explained"], 12) for x in r if x["component"] == c} == {round(float(share[c - 1]), 12)}


def test_whitening_odd_tables(spark):
    cols = "vec_id long, embedding array<float>"
    assert wh.whiten(spark.createDataFrame([], cols)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None), (2, [])], cols)).count() == 0
    one = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0])], cols)).collect()  # no variance at all
    assert [(x["whitened"], x["explained"], x["identity_error"]) for x in one] == [(0.0, 0.0, 0.0)] * 2
    flat = wh.whiten(spark.createDataFrame([(k, [float(k), 7.0, float(k)]) for k in range(30)], cols)).collect()
    assert len(flat) == 90 and {x["whitened"] for x in flat if x["component"] > 1} == {0.0}
    assert flat[0]["identity_error"] < 1e-9 and max(x["explained"] for x in flat) == pytest.approx(1.0)
    huge = wh.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and all(math.isfinite(x["whitened"]) for x in huge)


# --- the registered queries ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, quality):
    root = str(tmp_path_factory.mktemp("sf"))
    rows, docs, labels = quality
    docs.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).write.parquet(
        f"{root}/documents.parquet")
    labels.withColumn("toxic", F.lit(0)).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(trie_rows("random"), "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    rng = np.random.default_rng(6)
    spark.createDataFrame([(k, rng.normal(size=5).tolist(), 1) for k in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{root}/embeddings.parquet")
    return root


def test_quality_query(spark, folder, quality):
    r = {x["doc_id"]: x for x in Q.op11_line_crf(spark, folder).collect()}
    for i, _, g in quality[0]:
        assert r[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r[i]["predicted"] == int(r[i]["score"] >= 0.5)
    held = [(i, g) for i, _, g in quality[0] if r[i]["held_out"]]
    assert sum(r[i]["predicted"] == g for i, g in held) >= 0.95 * len(held)


def test_trie_query(spark, folder):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in Q.op12_zfast_trie(spark, folder).select(*cols).collect()), key=repr) == trie_brute(trie_rows("random"))


def test_whitening_query(spark, folder):
    r = Q.op13_rank_one(spark, folder)
    assert dict(r.dtypes)["deviation"] == "bigint" and r.count() == 300
    vectors = [x["embedding"] for x in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()]
    dev, _, share = whiten_brute(vectors, 5)
    rows = r.where("component = 2").orderBy("vec_id").collect()
    assert [x["deviation"] for x in rows] == dev and rows[0]["explained"] == pytest.approx(share[1])
