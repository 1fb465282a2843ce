"""Whitening, vector codes and host rules against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import host_rules, vector_codes, whitening
from strandline.llm.queries import queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int, x string, n bigint, error string, of int, code int"


def table(spark, vectors, labels=None):
    rows = [(i, v, labels[i] if labels else 1, "x", 1, "e", 1, 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, VECTORS)


def random_vectors(n, d, seed=0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.3).astype(np.float32)


BAD = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0]]


# Whitening


def plain_whitening(vectors, k=16):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = ((n * fit - s) / n).astype(np.float64)
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    y = ((n * x - s) / n).astype(np.float64) @ u / np.sqrt(e)
    return n, [int(v) for v in ((n * x - s) ** 2).sum(axis=1)], y, e / np.trace(cov)


@pytest.mark.parametrize("n,d", [(300, 64), (400, 90), (50, 3)])
def test_whitening_equals_plain_eigenvectors(spark, n, d):
    vectors = random_vectors(n, d).tolist()
    vectors += vectors[:20] * 5  # copies weigh nothing
    t = table(spark, vectors + [b * (d // 2) + [1.0] * (d % 2) if b else b for b in BAD])
    fitted = whitening.fit(t)
    count, deviation, y, explained = plain_whitening(vectors)
    got = whitening.whiten(t, fitted).toPandas()
    assert fitted.residual <= 1e-12 and fitted.identity_error < 1e-9
    assert len(got) == len(vectors) * min(16, d) and set(got.n) == {count}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((wide * y).sum(axis=0))
    assert np.abs(wide * sign - y).max() < 1e-8
    assert got.groupby("vec_id").deviation.first().tolist() == deviation
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-10)


def test_whitening_of_few_and_no_vectors(spark):
    assert whitening.fit(table(spark, BAD)) is None
    assert whitening.whiten(table(spark, BAD), None).count() == 0
    assert whitening.whiten(table(spark, []), whitening.fit(table(spark, []))).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = table(spark, [[1.0, 2.0]] * 3)
    assert whitening.whiten(one, whitening.fit(one)).count() == 0  # nothing varies
    line = table(spark, [[float(i), 2.0 * i] for i in range(9)])
    assert whitening.fit(line).values.shape == (1,)
    with pytest.raises(ValueError, match="one length"):
        whitening.fit(table(spark, [[1.0], [1.0, 2.0]]))
    # Equal eigenvalues: any basis of their space, whitened all the same.
    ring = table(spark, [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0], None])
    got = whitening.whiten(ring, whitening.fit(ring)).toPandas()
    assert len(got) == 8 and np.allclose(got.groupby("component").whitened.apply(lambda a: (a**2).mean()), 1)


def test_lobpcg_of_a_large_matrix_needs_no_full_basis():
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.normal(size=(400, 400)))
    e = np.concatenate([[50, 50, 49.9, 20], np.linspace(10, 1, 396)])
    a = q * e @ q.T
    calls = []

    def times(block):
        calls.append(block.shape[1])
        return a @ block

    values, vectors, residual, _ = whitening.lobpcg(times, r.normal(size=(400, 12)), 4, 1e-12, 1000)
    assert np.allclose(values, e[:4], rtol=1e-12) and residual <= 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-10 and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert max(calls) <= 24
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(times, r.normal(size=(400, 4)), 4, 1e-12, 3)


def test_deviation_is_exact_or_an_error():
    x, sums = np.array([[2**31, 0]]), np.array([0, 0])
    assert whitening._deviation(x, 1, sums) == [2**62]
    assert whitening._deviation(x, 3, sums) == [9 * 2**62]  # no long: Arrow refuses it


def test_whitening_query(spark):
    got = queries()["op11_whiten_embeddings"](spark, SF).toPandas()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, deviation, y, _ = plain_whitening(vectors.embedding.tolist())
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(wide) - np.abs(y)).max() < 1e-7 and got.groupby("vec_id").deviation.first().tolist() == deviation


# Vector codes


def plain_codes(vectors, parts=16, entries=64, rounds=2):
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], dtype=np.int64).reshape(len(vectors), parts, -1)
    books = [[x[i, p].copy() for i in range(min(entries, len(x)))] for p in range(parts)]

    def assign():
        far = [[[int(((v - b) ** 2).sum()) for b in books[p]] for v in x[:, p]] for p in range(parts)]
        return [[min(range(len(f)), key=lambda k: (f[k], k)) for f in far[p]] for p in range(parts)], far

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [x[i, p] for i in range(len(x)) if at[p][i] == k]
                if mine:
                    books[p][k] = np.array([int(c) // len(mine) for c in sum(mine)])
    at, far = assign()
    text = ",".join(str(int(c)) for p in range(parts) for b in books[p] for c in b)
    codes = ["".join(f"{at[p][i]:02x}" for p in range(parts)) for i in range(len(x))]
    return codes, [sum(far[p][i][at[p][i]] for p in range(parts)) for i in range(len(x))], hashlib.sha256(text.encode()).hexdigest()


def test_codes_equal_a_full_search(spark):
    vectors = (random_vectors(150, 32, 3) * 0.2).tolist()
    vectors += vectors[:10] * 3 + [[0.0] * 32] * 5
    labels = [i % 3 if i % 4 else None for i in range(len(vectors))]
    bad = [b * 16 if b else b for b in BAD]
    t = table(spark, vectors + bad, labels + [0] * len(bad))
    codes, error, told = plain_codes(vectors)
    got = vector_codes.coded(t).orderBy("vec_id").toPandas()
    assert got.code.tolist() == codes and got.error.tolist() == error and set(got.codebooks_sha256) == {told}
    sums = defaultdict(int)
    for label, e in zip(labels, error):
        sums[label] += e
    assert got.label_error.tolist() == [sums[label] for label in labels]
    # Labels beyond the bound of what is broadcast are joined by a shuffle.
    again = vector_codes.coded(t.repartition(5), vector_codes.CodeConfig(broadcast_labels=0)).orderBy("vec_id").toPandas()
    assert again.equals(got)


def test_codes_of_few_and_no_vectors(spark):
    few = [[0.1 * i] * 16 for i in range(3)]
    codes, error, told = plain_codes(few)
    got = vector_codes.coded(table(spark, few)).orderBy("vec_id").toPandas()
    assert got.code.tolist() == codes and error == got.error.tolist() == [0] * 3 and told == got.codebooks_sha256[0]
    assert vector_codes.coded(table(spark, BAD)).count() == 0 and vector_codes.coded(table(spark, [])).count() == 0
    for wrong in ([[1.0] * 20], [[1.0] * 16, [1.0] * 32], [[2.0**24] * 16]):
        with pytest.raises(ValueError):
            vector_codes.train(table(spark, wrong))
    rows = [(None, [0.5] * 16, 1), (7, [0.25] * 16, 1), (7, [-0.25] * 16, None), (7, [-0.25] * 16, None)]
    got = vector_codes.coded(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    assert sorted((r["vec_id"] is None, r["code"][:2]) for r in got.collect()) == [(False, "00"), (False, "00"), (False, "02"), (True, "03")]


def test_codes_decode_to_their_entries(spark):
    t = table(spark, (random_vectors(80, 32, 4) * 0.2).tolist())
    books = vector_codes.train(t)
    rows = vector_codes.decode(vector_codes.encode(t, books), books).join(t.select("vec_id", "embedding"), "vec_id").collect()
    for r in rows:
        x = np.floor(256 * np.array(r["embedding"], dtype=np.float64)).astype(int)
        assert ((x - np.array(r["decoded"])) ** 2).sum() == r["error"]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 40), st.integers(1, 30), st.integers(0, 10**6), st.sampled_from([2, 5, 1000]))
def test_partial_distances_find_the_nearest(width, entries, rows, seed, span):
    r = np.random.default_rng(seed)
    x, book = r.integers(-span, span, (rows, width)), r.integers(-span, span, (entries, width))
    index, far = vector_codes.nearest(x, book, 7)
    full = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert far.tolist() == full.min(axis=1).tolist() and index.tolist() == full.argmin(axis=1).tolist()


# Host rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, again = set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            cover |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(cover)


TEXTS = [None, "", " \n\t", "one", "a b", "a b c", "a b c d", "a a a", "a a a a", "x y z x y z", "p q r s p q r t q r s", "#tag & <b>x</b>|", "l one\nl two\nl one\n\nl one\r\nl one", "naïve café 漢字 漢字 漢字 漢字", "w\x0bv\x0cu\rt", "ab c d ab c d a bc d", "lorem ipsum dolor " * 20000]


def test_measures(spark):
    r = np.random.default_rng(5)
    texts = TEXTS + [" ".join(r.choice(list("abcd\n"), size=n)) for n in r.integers(0, 60, 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("source", F.lit("s"))
    got = {m["doc_id"]: m for m in host_rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        m = got[i]
        want = plain_measures(t)
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == want, t
        assert m["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


GOOD = " ".join(f"w{i}" for i in range(60))


def hosts(spark, failed):
    """``failed``: host -> (bad documents, good documents)."""
    rows = [(h, "short" if i < bad else GOOD) for h, (bad, good) in failed.items() for i in range(bad + good)]
    return spark.createDataFrame([(i, h, t, "k", 1.0) for i, (h, t) in enumerate(rows)], "doc_id bigint, source string, text string, host string, rate double")


def test_bad_hosts_go_and_small_ones_are_drawn_to_the_rest(spark):
    failed = {f"ok{i}": (i % 3, 40) for i in range(20)} | {"bad": (70, 6), "tiny": (1, 1), None: (30, 3)}
    docs = hosts(spark, failed)
    judged = host_rules.judge(docs).toPandas()
    assert set(judged[judged.host_rules.str.len() > 0].host) == {"bad"}
    clean = judged[~judged.base_failed]
    assert not clean[clean.host == "bad"].kept.any() and clean[clean.host != "bad"].kept.all()
    assert clean[clean.host == "tiny"].kept.all() and clean[clean.host.isna()].kept.all()
    kept = host_rules.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(judged[judged.kept].doc_id)
    by_shuffle = host_rules.judge(docs, host_rules.HostConfig(broadcast_hosts=0)).toPandas()
    assert judged.sort_values("doc_id").drop(columns="host_rules").reset_index(drop=True).equals(by_shuffle.sort_values("doc_id").drop(columns="host_rules").reset_index(drop=True))


def test_rates_are_those_of_the_beta_binomial(spark):
    failed = {"a": (5, 45), "b": (30, 20), "c": (0, 50), "d": (2, 3), "e": (9, 91)}
    m = host_rules.measured(hosts(spark, failed).select(F.col("source").alias("host"), "text"))
    got = {r["host"]: r for r in host_rules.host_rates(m).where("rule = 'few_words'").collect()}
    n, f = {h: sum(v) for h, v in failed.items()}, {h: v[0] for h, v in failed.items()}
    total, p = sum(n.values()), sum(f.values()) / sum(n.values())
    s = sum(n[h] * (f[h] / n[h] - p) ** 2 for h in n)
    c = (s - p * (1 - p) * (len(n) - 1)) / (p * (1 - p) * (total - sum(v * v for v in n.values()) / total - (len(n) - 1)))
    strength = (1 - c) / c
    for h in n:
        assert got[h]["rate"] == pytest.approx((f[h] + p * strength) / (n[h] + strength))
        assert abs(got[h]["rate"] - p) <= abs(f[h] / n[h] - p) + 1e-12


def test_one_host_all_failing_and_no_rows(spark):
    assert not host_rules.judge(hosts(spark, {"a": (0, 5)})).where("not kept").count()
    # All hosts fail always: the prior says so too.
    assert host_rules.judge(hosts(spark, {"a": (40, 0), "b": (40, 0)})).where("kept").count() == 0
    none = hosts(spark, {"a": (1, 0)}).limit(0)
    assert host_rules.judge(none).count() == 0 and host_rules.kept_documents(none).columns == none.columns


def test_host_rules_run_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (host_rules.judge(docs), host_rules.kept_documents(docs), host_rules.host_rates(host_rules.measured(docs.withColumn("host", F.col("source"))))):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
