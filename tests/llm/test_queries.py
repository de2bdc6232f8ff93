"""The registered queries that SQL cannot express, over a stored ``documents`` table, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10, sqrt

import numpy as np
import pytest

from relindex.llm import langid, pii
from relindex.llm import queries as Q

from .test_operators import SCHEMA, by_id, bytes_brute, made_up, ppm_brute


def crc(i):
    return zlib.crc32(str(i).encode())


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def rows():
    langs = ["en", "de", None, "fr"]
    mixed = ["Mail a.b@example.com or +49 30 1234567, 10.0.0.300 and 10.1.2.3", "card 4111 1111 1111 1111 and 4111 1111 1111 1112 " * 3,
             "no word here: 123 !?", "漢字かな交じり文" * 30, "\U00010400\U00010428 deseret"]
    texts = [*made_up(11), *mixed]
    return [(5 * k + 2, t, langs[k % 4], "s", len(t)) for k, t in enumerate(texts)] + [(100_001, None, "en", None, None)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    return root


def test_op1(spark, folder, rows):
    r = by_id(Q.op1_order_minhash(spark, folder))
    order = [(i, t or "") for i, t, *_ in sorted(rows)]
    assert len(r) == len(order)
    prints = {}
    for k, (i, t) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        assert (r[i]["n_chars"], r[i]["edited_sha256"]) == (len(t), sha(edited.encode()))
        own, other = (re.findall("." * 8, r[i][c]) for c in ("fingerprint", "edited_fingerprint"))
        assert len(own) == (64 if t.strip() else 0) and len(other) == (64 if edited.strip() else 0)
        near = 1.0 if not own and not other else len({*own} & {*other}) / 64
        assert r[i]["near_edited"] == pytest.approx(near, abs=1e-6)
        assert prints.setdefault(t, r[i]["fingerprint"]) == r[i]["fingerprint"]
        assert prints.setdefault(edited, r[i]["edited_fingerprint"]) == r[i]["edited_fingerprint"]


def test_op2(spark, folder, rows):
    r = by_id(Q.op2_ppm(spark, folder))
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b" "]
    train = [t for i, t, *_ in rows if crc(i) % 7 != 2]
    count = Counter(w for t in train for w in words(t))
    n, v = sum(count.values()), len(count)
    brute = ppm_brute([(t or "").encode() for t in train], [(t or "").encode() for _, t, *_ in rows])
    for (i, t, *_), expected in zip(rows, brute, strict=True):
        w, x = words(t), r[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (crc(i) % 7 == 2, len(w), sum(count[y] > 0 for y in w), n)
        assert x["base_score"] == pytest.approx(sum(log10((count[y] + 1) / (n + v + 1)) for y in w)) and x["score"] == pytest.approx(expected)


def test_op3(spark, folder, rows):
    r = by_id(Q.op3_prefix_doubling(spark, folder))
    for (i, *_), e in zip(rows, bytes_brute([(t or "").encode() for _, t, *_ in rows]), strict=True):
        assert (r[i]["n_bytes"], r[i]["n_removed"], r[i]["n_spans"], r[i]["kept_sha256"]) == (*e[:3], sha(e[3]))


def bundle_brute(text, vectors):
    """Sum of the bound vectors of every trigram of the small letters, words between single blanks."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "").split()
    if not low:
        return None
    padded, total = f" {' '.join(low)} ", np.zeros(langid.DIM, dtype=np.int64)
    for k in range(max(1, len(padded) - 2)):
        bound = np.ones(langid.DIM, dtype=np.int64)
        for place, c in enumerate(padded[k:k + 3]):
            if c not in vectors:
                vectors[c] = np.random.default_rng([langid.SEED, ord(c)]).integers(0, 2, langid.DIM, dtype=np.int8).astype(np.int64) * 2 - 1
            bound = bound * np.roll(vectors[c], 2 - place)
        total += bound
    return total


def test_op9(spark, folder, rows):
    r, vectors, languages = by_id(Q.op9_hyperdimensional(spark, folder)), {}, defaultdict(lambda: np.zeros(langid.DIM))
    bundles = {i: bundle_brute(t, vectors) for i, t, *_ in rows}
    for i, _, lang, *_ in rows:
        if crc(i) % 4 != 2 and lang is not None and bundles[i] is not None:
            languages[lang] += bundles[i]
    for i, *_ in rows:
        b = bundles[i]
        assert r[i]["held_out"] == (crc(i) % 4 == 2)
        if b is None:
            assert (r[i]["lang_pred"], r[i]["score"]) == ("und", 0.0)
            continue
        cos = {k: float(b @ v) / sqrt(float(b @ b) * float(v @ v)) for k, v in languages.items()}
        assert cos[r[i]["lang_pred"]] == pytest.approx(max(cos.values()), abs=1e-5)
        assert r[i]["score"] == pytest.approx(min(1.0, max(0.0, max(cos.values()))), abs=1e-5)


def test_equal_cosines_go_to_the_first_language(spark):
    docs = spark.createDataFrame([("zz", "one two three"), ("bb", "one two three"), ("cc", "vier funf")], "lang string, text string")
    told = langid.identify(spark.createDataFrame([(1, "one two three")], "doc_id long, text string"), langid.train(docs)).first()
    assert told["lang_pred"] == "bb" and told["score"] == pytest.approx(1.0, abs=1e-6)


def test_op10(spark, folder, rows):
    r, kinds = by_id(Q.op10_crf(spark, folder)), ["email", "ip", "card", "phone"]
    assert len(r) == len(rows)
    found = Counter()
    for i, t, *_ in rows:
        base = pii.base_spans(t or "")
        told = [f"{kinds[k]}:{lo}:{hi}" for k, lo, hi in base]
        assert [r[i][f"n_{k}"] for k in kinds] == [sum(x == j for x, *_ in base) for j in range(4)]
        assert r[i]["base_sha256"] == sha(",".join(told).encode())
        assert {*told} <= {*filter(None, r[i]["spans"].split(","))}
        found.update(kinds[k] for k, *_ in base)
    assert found == {"email": 1, "ip": 1, "card": 3, "phone": 1}
