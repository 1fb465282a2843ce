"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import math
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from strandline.llm import chat_format, decontaminate, hnsw, language_id, lm_score, mixing, partenum, token_counts, token_store, toxicity
from strandline.llm.attention import AttentionConfig
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet consectetur " * 2000
TEXTS = [None, "", "   \n", "one", "one two", "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", LONG, LONG, "naïve café, übermäßig — 漢字 <|endoftext|> end"]
# Columns with the names that the operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, node bigint, component bigint, block bigint, rank int, n_tokens string, seq int, part int, copies int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], None if t is None else len(t), "k", 1, 1, 1, 1, "x", 1, 1, 1) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id here at all", None, None, 3, "k", 1, 1, 1, 1, "x", 1, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(spark, docs, none):
    got = mixing.mix(docs, mixing.MixConfig(budget_num=1, budget_den=1)).collect()
    assert sum(r["n_tokens"] * r["copies"] for r in got) <= sum(len((t or "").split()) for t in TEXTS) + 14 + 5
    assert len([r for r in got if r["doc_id"] == 5]) in (0, 2)
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs, mixing.MixConfig(budget_num=0)).where("n_tokens > 0").count() == 0


def test_mixing_gives_shortage_to_siblings_first(spark):
    # a holds 10 tokens in all, so a/x's sibling a/y takes what x lacks, before domain b does.
    rows = [(i, " ".join(["w"] * 5), s, f"{s}{l}") for i, (s, l) in enumerate([("a", "x"), ("a", "y"), ("a", "y"), ("a", "y"), *[("b", "x")] * 20])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    leaves = d.groupBy(F.col("lang").alias("domain"), F.lit("").alias("lang"), "source").agg((F.count("*") * 5).alias("tokens"))
    total = spark.range(1).select(F.lit(40).cast("long").alias("parent_budget"))
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, total, mixing.MixConfig(max_epochs=1)).collect()}
    assert got == {"ax": 5, "ay": 15, "bx": 20}
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, spark.range(1).select(F.lit(60).cast("long").alias("parent_budget")), mixing.MixConfig(max_epochs=1)).collect()}
    assert got == {"ax": 5, "ay": 15, "bx": 40}


def test_mixing_epochs(spark):
    d = spark.createDataFrame([(i, "a b c", "en", "s") for i in range(10)], "doc_id bigint, text string, lang string, source string")
    got = mixing.mix(d, mixing.MixConfig(budget_num=3, budget_den=2, max_epochs=3)).collect()
    assert Counter(r["copies"] for r in got) == {1: 5, 2: 5}
    again = mixing.mix(d.repartition(5), mixing.MixConfig(budget_num=3, budget_den=2, max_epochs=3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def brute_contamination(text, items, window=13):
    words = decontaminate.words_of(None if text is None else text.encode())
    hit, ids = set(), set()
    for item, t in items:
        w = decontaminate.words_of(None if t is None else t.encode())
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    ids.add(str(item))
    return len(words), len(hit), ids


@pytest.mark.parametrize("max_words", [1_000_000, 5])
def test_decontaminate(spark, docs, none, max_words):
    items = [(1, TEXTS[5]), (2, None), (3, ""), (4, "two"), (10, "dolor sit amet"), (10, "kappa LAMBDA"), (7, "not there at all")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(docs, bench, decontaminate.DecontaminateConfig(max_words=max_words)).collect()
    assert len(got) == docs.count()
    by = {(r["doc_id"]): r for r in got}
    for i, t in enumerate(TEXTS):
        n, hit, ids = brute_contamination(t, items)
        r = by[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(ids)), t
        assert r["items_sha256"] == decontaminate.items_digest(list(ids))
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert decontaminate.contamination(none, bench).count() == 0
    empty = decontaminate.contamination(docs, spark.createDataFrame([], "item_id bigint, text string"))
    assert empty.where("contaminated or n_hit > 0").count() == 0
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r["contaminated"] for r in got)


def test_remove_spans():
    assert decontaminate.remove_spans("One, two! three four.", [(1, 3)]) == "One,  four."
    assert decontaminate.remove_spans(None, []) is None


SMALL_LM = lm_score.ScoreConfig(attention=AttentionConfig(steps=20, batch=8, initial=10, inner=8), block_bytes=20_000)


def test_lm_score(spark, docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lm_score.score(docs, path, SMALL_LM).collect()
    assert len(got) == docs.count()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expect = sorted((-1 if i is None else i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == expect
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert lm_score.score(none, path, SMALL_LM).count() == 0


def test_lm_learns_from_texts_beyond_the_sample(spark):
    """Classes and weights come from chosen texts of all blocks, here all, not from the sample that they start from."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    r = np.random.default_rng(6)
    text = lambda words: " ".join(r.choice(words, 40)).encode()
    rows = [(i, text(["the", "river", "and", "house"])) for i in range(20)] + [(i, text(["quantum", "zebra"])) for i in range(20, 200)]
    training = spark.createDataFrame(rows, "doc_id bigint, text binary").withColumn("block", F.col("doc_id") % 5)
    once = spark.createDataFrame([(w.decode(), n) for w, n in Counter(w for _, t in rows for w in t.split() + [b"\n"]).items()], "word string, c bigint")
    once = lm_score.spell(once, path)
    assert AttentionConfig().hidden == 32 and AttentionConfig().initial + AttentionConfig().inner == 192
    config = lm_score.ScoreConfig(attention=AttentionConfig(steps=20, batch=8, initial=10, inner=8, window=8, tune_batch=8, tune_rate=1e-2), sample_texts=1)
    model = lm_score.train_attention(training, once, path, config)
    subwords = lm_score._subwords(path)
    for w in ("quantum", "zebra"):
        for i in subwords.encode(w):
            assert model.classes.of[i] not in (8, 17)  # not the shared classes of what was never seen
    stream = lm_score._stream([t for i, t in rows[150:]], subwords)
    sample_only = lm_score.train_attention(training, once, path, replace(config, attention=replace(config.attention, tune_rate=0.0)))
    loss = lambda m: -lm_score.score_streams(m, stream[1:], np.array([0]))[0].mean()
    assert loss(model) < loss(sample_only) - 0.1


def test_lm_scores_add_up():
    """Within-class tables and class probabilities sum to 1, and each subword is scored once."""
    from strandline.llm.attention import Model, make_classes, score_streams

    r = np.random.default_rng(0)
    c = AttentionConfig(steps=5, batch=4, initial=6, inner=5, window=8)
    ids = np.concatenate([np.concatenate([r.integers(0, 50, k), [50]]) for k in (3, 30, 17)])
    model = Model(c, make_classes(ids, np.arange(51) < 20, 50, c))
    model.train(np.tile(ids, 5))
    starts = np.array([0, 4, 35])
    table = lm_score.within_class(np.ones((12, 51)), model)
    assert np.allclose([np.bincount(model.classes.of, weights=np.exp(row), minlength=11).max() for row in table], 1, atol=1e-5)
    within, kind = score_streams(model, ids, starts)
    assert len(within) == len(ids) and (within <= 1e-5).all() and (kind <= 1e-5).all()
    some = r.random(len(ids)) < 0.5  # what is not asked for changes nothing
    assert np.allclose(score_streams(model, ids, starts, some), np.where(some, [within, kind], 0), atol=1e-5)
    # The same numbers one place at a time, from the same context.
    for k in (36, 44, 52):
        j = (k - 35) // 4 * 4
        before = np.concatenate([[model.classes.rows - 1], model.classes.row[ids[35 : k]]])[max(0, j - 4) : k - 35 + 1]
        y = model._forward(before[None], 1)[9][0, 0]
        z = y @ model.w["O"] + model.w["o"]
        target, begins = model.classes.of[ids[k]], 1 / (1 + np.exp(-(y @ model.w["G"] + model.w["g"])[0]))
        z = z[:6] if target < 6 else np.concatenate([np.full(6, -np.inf), z[6:]])
        assert within[k] == pytest.approx(z[target] - np.log(np.exp(z).sum()), abs=1e-3)
        assert kind[k] == pytest.approx(np.log(begins if target < 6 else 1 - begins), abs=1e-3)


def test_lm_gradients_are_those_of_the_loss():
    from strandline.llm.attention import Model, make_classes

    r = np.random.default_rng(1)
    c = AttentionConfig(width=4, hidden=5, initial=6, inner=5, window=8)
    ids = r.integers(0, 51, 400)
    model = Model(c, make_classes(ids, np.arange(51) < 20, 50, c))
    model.init()
    model.w = {k: (v + r.normal(size=v.shape) * 0.1).astype(np.float64) for k, v in model.w.items()}
    rows, target = model.classes.row[ids[:24]].reshape(3, 8), model.classes.of[ids[1:25]].reshape(3, 8)
    _, g = model._gradient(rows, target)
    for k in model.w:
        at = tuple(int(r.integers(0, n)) for n in model.w[k].shape) if k != "E" else (int(rows[1, 3]), 2)
        losses = []
        for step in (1e-4, -1e-4):
            model.w[k][at] += step
            losses.append(model._gradient(rows, target)[0])
            model.w[k][at] -= step
        assert g[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, abs=2e-4), k


def test_lm_score_beats_counts_on_held_out_texts(spark):
    """Two languages with words of their own, and new words of their syllables: context tells more than counts."""
    r = np.random.default_rng(8)
    parts = [["ra", "ki", "to", "mun", "sel"], ["bla", "grö", "schi", "peng", "dorf"]]
    words = [["".join(r.choice(p, r.integers(1, 4))) for _ in range(120)] for p in parts]
    rows = [(i, " ".join(r.choice(words[i % 2], 60)) + (" " + "".join(r.choice(parts[i % 2], 4)) if i % 5 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    config = lm_score.ScoreConfig(attention=AttentionConfig(steps=250, batch=32, initial=24, inner=24, window=16))
    got = lm_score.score(df, public_tokenizers.path("piece_bpe_32k.model"), config).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.1


def test_token_counts(spark, docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, safe = token_counts.load(path)
    assert safe
    for config in (token_counts.TokenCountConfig(), token_counts.TokenCountConfig(chunk_chars=50, overlap_chars=4)):
        got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, path, config=config).collect()}
        for i, t in enumerate(TEXTS):
            n = len(model.encode(t or ""))
            assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096)
    assert token_counts.count_tokens(docs, path).count() == docs.count()
    assert token_counts.count_tokens(none, path).count() == 0


def test_chunks_resynchronise():
    model, _ = token_counts.load(public_tokenizers.path("piece_bpe_32k.model"))
    r = np.random.default_rng(2)
    words = ["the", "über", "x" * 70, "12,5", "漢字", "  ", "\n", "ation", "</s>", "Ｆｕｌｌ", "ﬁ", "é", "é"]
    for size, overlap in ((40, 3), (64, 16), (300, 20)):
        for _ in range(30):
            text = " ".join(r.choice(words, r.integers(1, 200)))
            assert token_counts.count_chunked(model, text, token_counts.TokenCountConfig(chunk_chars=size, overlap_chars=overlap)) == len(model.encode(text))
    solid = "x" * 5000  # nowhere to splice: the overlap widens to the whole
    assert token_counts.count_chunked(model, solid, token_counts.TokenCountConfig(chunk_chars=300, overlap_chars=20)) == len(model.encode(solid))


def test_language_id(spark, docs, none):
    learned = language_id.train(docs)
    assert [lang for lang, _ in learned] == ["de", "en"] or [lang for lang, _ in learned] == ["en", "de"]
    got = {r["doc_id"]: r for r in language_id.identify(docs, learned).collect()}
    for i in (0, 1, 2):
        assert got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(docs, learned).count() == docs.count()
    assert language_id.identify(docs, language_id.train(none)).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(none, learned).count() == 0
    kept = language_id.identify(docs, learned, keep=list(docs.columns))
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.where("text is not null").count() == docs.where("text is not null").count()


def test_dictionaries_are_of_whole_texts(spark):
    """A header that opens every text does not fill its language's dictionary."""
    header = "licensed under the terms stated here " * 60
    rows = [(i, header + f"{body} " * 1500, lang) for i in range(40) for lang, body in (("xx", "quenya"), ("yy", "sindar"))]
    learned = dict(language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
    assert learned["xx"].count(b"quenya") > 1000 and learned["yy"].count(b"sindar") > 1000
    assert language_id.LanguageConfig().slots * language_id.LanguageConfig().per_slot == 128


def test_token_store(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for config in (token_store.TokenStoreConfig(), token_store.TokenStoreConfig(shard_tokens=7)):
        got = token_store.read(token_store.write(docs, path, config)).orderBy("start").collect()
        start, expect = 0, []
        for i, text in rows:
            ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
            expect.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert [tuple(r) for r in got] == expect
    assert token_store.read(token_store.write(none, path)).count() == 0


def test_wavelet_matrix():
    r = np.random.default_rng(1)
    for ids in (np.array([], np.uint32), np.array([0]), np.array([5, 5, 5]), r.integers(0, 60_000, 3000) ** 2 % 70_000, r.integers(0, 9, 2000)):
        m = token_store.WaveletMatrix.build(ids.astype(np.uint32))
        assert (m.decode() == ids).all()
        assert all(m.access(i) == ids[i] for i in range(0, len(ids), 53))
        for token in {*ids[:5].tolist(), 3, 1 << 18}:
            places = np.flatnonzero(ids == token).tolist()
            assert m.count(token) == len(places) and m.occurrences(token) == places
            assert m.count(token, len(ids) // 2) == int((ids[: len(ids) // 2] == token).sum())
    data = token_store.write_shard([1, None, 3], [2, 1, 1], np.array([9, 2, 2, 2]))
    assert [(d, s, ids.tolist()) for d, s, ids in token_store.Shard(data).documents()] == [(1, 0, [9, 2]), (None, 2, [2]), (3, 3, [2])]
    with pytest.raises(ValueError):
        token_store.Shard(data + b"x")


def test_encoder_equals_library():
    import random

    e = token_store.encoder(public_tokenizers.path("byte_bpe_50k.json"), token_store.TokenStoreConfig())
    rnd = random.Random(3)
    bits = [*" ab'sétß.,!?\n\t 12²½漢ǅ́\x1c", "<|endoftext|>", "'re", "  ", "word.", "’s"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert e.encode(text) == e.whole(text), repr(text)


def test_toxicity(spark, none):
    rows = [(i, f"good words here number{i % 7} plain" + (" vile insult" if i % 4 == 0 else ""), int(i % 4 == 0), int(i % 5 == 0)) for i in range(200)]
    d = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(900, None), (901, ""), (902, LONG), (902, LONG)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, a, b) for i, _, a, b in rows] + [(900, None, 1), (5000, 1, 1)], "doc_id bigint, toxic int, low int")
    chain = toxicity.train(d, labels, ["low", "toxic"])
    got = {r["doc_id"]: r for r in toxicity.classify(d, chain).collect()}
    assert all(got[i]["toxic"] == bool(a) for i, _, a, _ in rows)
    assert not got[900]["toxic"] and not got[901]["toxic"] and not got[902]["toxic"]
    assert toxicity.classify(d, chain).count() == 204
    blank = toxicity.train(none.select("doc_id", "text"), labels, ["low", "toxic"])
    assert toxicity.classify(d, blank).where("toxic").count() == 0


def test_toxic_words_outside_the_sample(spark):
    """Words come from all labelled rows: a toxic one that the sample lacks still decides."""
    order = [r["id"] for r in spark.range(400).orderBy(F.xxhash64("id")).collect()]
    rare = set(order[-30:])
    toxic = set(order[:100:4]) | rare
    d = spark.createDataFrame([(i, f"good words here number{i % 7} plain" + (" odious" if i in rare else " vile" if i in toxic else "")) for i in order], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in order], "doc_id bigint, toxic int")
    chain = toxicity.train(d, labels, ["toxic"], toxicity.ToxicityConfig(sample=100))
    assert {r["doc_id"] for r in toxicity.classify(d, chain).where("toxic").collect()} == toxic
    assert (toxicity.ToxicityConfig().sample, toxicity.ToxicityConfig().features, toxicity.ToxicityConfig().steps) == (20_000, 3000, 300)


def test_embedding_near(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + r.normal(size=16) * 0.05 * (i % 3)).tolist(), 1) for i in range(240)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [1.0, None] + [0.0] * 14, 1), (1004, [float("nan")] * 16, 1), (1005, [float("inf")] + [1.0] * 15, 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, rows[0][1], 1), (1008, rows[0][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, node int").repartition(5)
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T >= 0.9
    for config in (hnsw.NearConfig(shards=3, block=64), hnsw.NearConfig(shards=2, shard_points=50, part_points=100, beam=2)):
        out = hnsw.near_duplicates(df, config).collect()
        assert len(out) == len(rows) + len(odd)
        got = {v["vec_id"]: v for v in out}
        for i in range(240):
            assert got[i]["n_links"] == sims[i].sum() - 1 + 2 * sims[i, 0]
        for i in range(1000, 1006):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
        assert got[1006]["n_links"] == 1 and got[1007]["component_id"] == 1006
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def brute_components(ids, sets, config):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(zip(ids, sets)):
        for j, b in zip(ids[:k], sets[:k]):
            both = len(np.intersect1d(a, b))
            if len(a) and len(b) and config.den * both >= config.num * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("config", [partenum.JoinConfig(), partenum.JoinConfig(words=5, num=80)])
def test_ngram_jaccard(spark, docs, none, config):
    r = np.random.default_rng(4)
    texts = list(TEXTS)
    for size in (12, 25, 60, 150):  # groups of near copies around one text, some at the very threshold
        base = [f"w{k}" for k in r.integers(0, 5000, size)]
        for _ in range(18):
            words = list(base)
            for _ in range(r.integers(0, max(2, size // 14))):
                words[r.integers(0, size)] = f"n{r.integers(0, 10**6)}"
            texts.append(" ".join(words[: size - r.integers(0, 3)]))
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, ids)), "doc_id bigint, text string, node bigint").repartition(4)
    got = {v["doc_id"]: v for v in partenum.similar(df, config).collect()}
    sets = [partenum.shingles(None if t is None else t.encode(), config) for t in texts]
    assert {i: got[i]["component_id"] for i in ids} == brute_components(ids, sets, config)
    assert all(got[i]["n_shingles"] == len(s) for i, s in zip(ids, sets))
    if config.words == 3:
        kept = partenum.keep_one(docs, config)
        assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 6").count() == 0
        assert partenum.similar(none, config).count() == 0


def test_ids_do_not_decide_whose_text_it_is(spark):
    """Null ids, and different texts under one id: links and kept rows follow the texts."""
    r = np.random.default_rng(12)
    text = lambda: [f"w{k}" for k in r.integers(0, 10**6, 60)]
    near = lambda words: " ".join([*words[:-1], "other"])
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, " ".join(a), "a"), (1, " ".join(b), "b"), (2, near(a), "a2"), (3, near(b), "b2")]
    rows += [(None, " ".join(c), "c"), (None, near(c), "c2"), (None, " ".join(d), "d"), (None, " ".join(e), "e"), (9, near(e), "e2"), (None, None, "n"), (None, "", "m"), (None, "", "o")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, name string").repartition(3)
    got = [(v["doc_id"], v["component_id"]) for v in partenum.similar(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 1), (1, 1), (2, 1), (3, 1), *[(None, None)] * 3, (None, 9), (9, 9), *[(None, None)] * 3]))
    kept = [v["name"] for v in partenum.keep_one(df).collect()]
    assert len({"c", "c2"} & set(kept)) == 1 and sorted(set(kept) - {"c", "c2"}) == ["a", "b", "d", "e2", "m", "n", "o"] and len(kept) == 8


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(9)
    for config in (partenum.JoinConfig(), partenum.JoinConfig(num=80)):
        bands = partenum.Bands(config)
        for _ in range(400):
            n = int(r.integers(bands.least, 400))
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            drop = int(r.integers(0, max(1, len(a) * (config.den - config.num) // config.den) + 1))
            b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**63, int(r.integers(0, drop + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if config.den * both >= config.num * (len(a) + len(b) - both) and len(b) >= bands.least:
                sig, stand, owner, band, need = partenum.signatures([a, b], bands)
                own = bands.band(min(len(a), len(b)))  # both stand in the smaller set's band
                x, y = (int(np.flatnonzero((owner == i) & (band == own))[0]) for i in (0, 1))
                assert len(set(sig[stand == x]) & set(sig[stand == y])) >= max(1, need[x], need[y])
                assert int(np.bitwise_count((partenum._bitmap(a) ^ partenum._bitmap(b)).view(np.uint64)).sum()) <= len(a) + len(b) - 2 * both


def test_chat_format(spark):
    rows = [(1, 2, "assistant", "b <|end|> \\ <\\| x"), (1, 1, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "c<"), (2, 1, None, "<|role|>"), (2, 1, None, "<|role|>"), (3, None, "user", "漢字"), (None, 1, "assistant", "z"), (4, 1, "us<|text|>er\\", "a|>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, blocks string, pieces int")
    made = chat_format.format_chats(df)
    out = {r["conv_id"]: r for r in made.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [tuple(t) for t in out[c]["turns"]] == [(role, text) for _, role, text in turns]
        assert out[c]["loss"] == "".join(text for _, role, text in turns if role == "assistant")
    assert out[1]["formatted"].count("<|role|>") == 2
    assert chat_format.format_chats(df.limit(0)).count() == 0
    assert "Python" not in made._jdf.queryExecution().toString()


def test_items_digest():
    assert decontaminate.items_digest(["2", "10"]) == hashlib.sha256(b"10,2").hexdigest()


def test_clashing_names_give_way(spark):
    """Input columns with the names of results: filters keep them as they came, results replace them."""
    rows = [(i, "the house by the river is green " * 3 if i % 2 else "das Haus am Fluss ist grün und alt " * 3, "en" if i % 2 else "de", f"s{i}", 1.5, "mine", 7, "yes", "no", 3) for i in range(20)]
    clash = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double, rejected string, n_words int, contaminated string, toxic string, n_tokens int")
    bench = spark.createDataFrame([(1, "das Haus am Fluss ist grün und alt")], "item_id bigint, text string")
    learned = language_id.train(clash)
    kept = language_id.clear_documents(clash, learned)
    assert kept.columns == clash.columns and set(map(tuple, kept.collect())) <= set(rows) and kept.count() > 0
    assert language_id.identify(clash, learned, keep=clash.columns).where("not rejected").columns.count("score") == 1
    clean = decontaminate.clean_documents(clash, bench)
    assert clean.columns == clash.columns and sorted(map(tuple, clean.collect())) == rows[1::2]
    assert decontaminate.contamination(clash, bench, keep=["doc_id", "N_words"]).where("contaminated").count() == 10
    chain = toxicity.train(clash, clash.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(1).alias("x")), ["x", "toxic"])
    judged = toxicity.classify(clash, chain, keep=clash.columns)
    assert judged.where("toxic").count() == 10 and judged.columns.count("toxic") == 1 and judged.columns[:2] == ["doc_id", "text"]
    assert toxicity.classify(clash.limit(0), chain, keep=clash.columns).count() == 0
    counts = token_counts.count_tokens(clash, public_tokenizers.path("piece_bpe_32k.model"), keep=clash.columns)
    assert counts.where("n_tokens > 3").count() == 20
    import corpus_pipeline

    more = clash.withColumn("chosen_", F.lit(1)).withColumn("kept_", F.lit(1)).withColumn("k1", F.lit(1)).withColumn("row", F.lit(1)).withColumn("of", F.lit(1))
    assert set(corpus_pipeline.mixed(spark, more, "").columns) == set(more.columns)
    assert corpus_pipeline.near_duplicates(spark, more, "").count() == 2


@pytest.mark.parametrize("max_words", [1_000_000, 8])
def test_items_without_an_id(spark, max_words):
    """Windows of items without an id hit, but name no item."""
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "epsilon zeta"), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, "alpha beta gamma delta"), (4, "epsilon zeta"), (None, None), (5, "delta"), (10, "delta")], "item_id bigint, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.contamination(docs, bench, decontaminate.DecontaminateConfig(max_words=max_words)).collect()}
    assert len(got) == 4 and (got[1, 4]["n_hit"], got[1, 4]["n_items"], got[1, 4]["items_sha256"]) == (4, 2, decontaminate.items_digest(["5", "10"]))
    assert (got[3, 2]["n_hit"], got[3, 2]["items_sha256"]) == (2, decontaminate.items_digest(["4"])) and got[3, 0]["n_hit"] == 0


def test_large_and_small_components(spark):
    """Norms that would over- or underflow: the direction alone decides."""
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1e-320, 0.0]), (5, [3.0, 0.0]), (6, [-1e200, 0.0])]
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(1, 7)] == [(2, 1), (2, 1), (2, 1), (1, 4), (1, 4), (0, 6)]


def test_shared_folder_is_named_on_a_cluster():
    from strandline.llm import common

    class Stub:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Stub)


def test_ambiguous_repeats_keep_one(spark):
    """Of rows with one id and one text the first by all columns stays."""
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(7, words, "b"), (7, words, "a"), (7, words.upper(), "c"), (8, words, "d")]
    kept = [partenum.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, name string").repartition(n)).collect() for n in (1, 4)]
    assert kept[0] == kept[1] and len(kept[0]) == 1 and kept[0][0]["doc_id"] == 7 and kept[0][0]["name"] in ("a", "c")


def test_spellings_are_the_librarys():
    """Words spelled together, from the cache and after it was emptied are spelled as the library does one by one."""
    model = lm_score._subwords(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["the", "river", lm_score.END, "½", "ﬁn", "漢字", "the", "x▁y", "naïve", "\u200b"] + [f"w{k}" for k in range(50)]
    before, lm_score.MOST_SPELLED = lm_score.MOST_SPELLED, 30
    try:
        for some in (words, words[::-1], words[:5], words):
            ids, sizes = lm_score._spell(model, some)
            want = [[model.get_piece_size()] if w == lm_score.END else model.encode(w) or [model.unk_id()] for w in some]
            assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    finally:
        lm_score.MOST_SPELLED = before


def test_lm_streams_are_spelled_once_and_joined():
    """Each text's subwords and an end, kept with its block; joined they are the texts' stream."""
    import pyarrow as pa

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts, subwords = [b"The River", None, b"", b"zebra \xe6\xbc\xa2 river"], lm_score._subwords(path)
    batch = pa.RecordBatch.from_arrays([pa.array([4, 4, 5, 6]), pa.array(texts, pa.binary())], names=["block", "text"])
    before = lm_score.AT_ONCE
    try:
        for lm_score.AT_ONCE in (1, 12, 1000):
            made = pa.Table.from_batches(lm_score._streams(iter([batch]), path))
            assert made.column("block").to_pylist() == [4, 4, 5, 6]
            rows = made.column("ids").to_pylist()
            assert lm_score._joined(rows, subwords.get_piece_size()).tolist() == lm_score._stream(texts, subwords).tolist()
            assert lm_score._joined(rows[3:], subwords.get_piece_size()).tolist() == lm_score._stream(texts[3:], subwords).tolist()
    finally:
        lm_score.AT_ONCE = before


def test_plain_texts_do_not_go_to_the_library_whole(monkeypatch):
    """Neither their first word nor words after line ends."""
    e = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"), token_store.TokenStoreConfig())
    texts = ["The one.\nThe two.\nÉté, then +1 (716) x-y.", "the end\nEnd", "A b."]
    want = [e.whole(t) for t in texts]
    monkeypatch.setattr(e, "whole", lambda text: pytest.fail(text))
    assert [e.encode(t) for t in texts] == want


def test_wavelet_matrix_over_many_runs():
    ids = np.random.default_rng(4).integers(0, 50_257, 2 * token_store.NEAR + 77).astype(np.uint32)
    m = token_store.WaveletMatrix.build(ids)
    assert (m.decode() == ids).all() and m.access(token_store.NEAR) == ids[token_store.NEAR]
    assert m.occurrences(int(ids[-1])) == np.flatnonzero(ids == ids[-1]).tolist()


def test_encoder_cuts_at_single_line_ends():
    e = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"), token_store.TokenStoreConfig())
    for text in ("one two.\nThe three.\nÉté two.\nThe end.", "a two.\n\nThe b", "a two. \nThe b", "a two.\n The b", "a two.\t\nThe b", "a two.\n", "\nThe two", "a 中\n中 b", "a \n"):
        assert e.encode(text) == e.whole(text)
    assert {"two.", "\nThe"} <= set(e.by_piece) and "two.\nThe" not in e.by_piece


def test_lm_texts_are_spelled_once_and_scored_by_that():
    """Blocks' words, their spellings, marked texts and scores, against plain loops; each distinct word is spelled once for all of it."""
    from strandline.llm.attention import Model, make_classes, score_streams

    path = public_tokenizers.path("piece_bpe_32k.model")
    real, asked = lm_score._subwords(path), []

    class Counting:
        get_piece_size, unk_id = real.get_piece_size, real.unk_id

        def encode(self, words, **more):
            asked.extend(words)
            return real.encode(words, **more)

    texts = [b"The River  and the\tzebra", None, b"", b" \n ", "Zebra ½ naïve\x0bx▁y river\x85".encode(), b"the and", b"quagga the quagga xylo", b"the and"]
    held, block = [False, False, True, False, False, False, True, False], [0, 0, 0, 0, 1, 1, 1, 1]
    words_of = lambda t: (t or b"").lower().split() + [b"\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(texts, pa.binary()), pa.array(held)], names=["block", "text", "held_out"])
    counts = Counter(w for t, h in zip(texts, held) if not h for w in words_of(t))
    lm_score._LOADED[path] = Counting()
    try:
        for size in (1, 3, 8):
            got = pa.Table.from_batches(lm_score._block_words(iter([batch.slice(k, size) for k in range(0, 8, size)]))).to_pylist()
            for b in (0, 1):
                distinct = sorted({w for t, of in zip(texts, block) if of == b for w in words_of(t)})
                n = Counter(w for t, h, of in zip(texts, held, block) if of == b and not h for w in words_of(t))
                assert [(r["k"], r["word"].encode(), r["n"]) for r in got if r["block"] == b] == [(k, w, n[w]) for k, w in enumerate(distinct)]
        rows = sorted(got, key=lambda r: r["word"])
        sent = pa.RecordBatch.from_arrays([pa.array([r["word"] for r in rows]), pa.array([r["block"] for r in rows]), pa.array([r["k"] for r in rows], pa.int32()), pa.array([counts[r["word"].encode()] for r in rows]), pa.array([True] * len(rows))], names=["word", "block", "k", "c", "first"])
        sent = pa.Table.from_batches(lm_score._spelled_words(iter([sent]), path))
        left = pa.table({"doc_id": pa.array(range(8)), "text": batch.column(1), "held_out": batch.column(2), "block": batch.column(0)})
        encoded = pa.concat_tables(lm_score._encoded(left.filter(pc.equal(left["block"], b)), sent.filter(pc.equal(sent["block"], b)).select(["k", "c", "ids"]), path) for b in (0, 1))
    finally:
        lm_score._LOADED[path] = real
    assert sorted(asked) == sorted({w.decode() for t in texts for w in words_of(t)})
    spell = lambda w: [real.get_piece_size()] if w == b"\n" else real.encode(w.decode()) or [real.unk_id()]
    stream = np.concatenate([[real.get_piece_size()], *(spell(w) for t in texts for w in words_of(t))])
    assert lm_score._joined(encoded["ids"].to_pylist(), real.get_piece_size()).tolist() == stream.tolist()
    c = AttentionConfig(steps=5, batch=4, initial=6, inner=5, window=4)
    model = Model(c, make_classes(np.tile(stream, 9), np.array([real.id_to_piece(i).startswith("▁") for i in range(real.get_piece_size())] + [True]), real.get_piece_size(), c))
    model.train(np.tile(stream, 9))
    r = np.random.default_rng(2)
    table, of_class = np.log(r.random((12, len(model.classes.of)))), r.random(11)
    scorer = type("Shared", (), {"value": lm_score.Scorer(model, table, sum(counts.values()), len(counts), 0.03, of_class)})()
    order = ["doc_id", "held_out", "n_tokens", "n_known", "block", "ids", "new", "log_more", "log_known"]
    got = pa.Table.from_batches(lm_score._scored(iter(encoded.select(order).combine_chunks().to_batches()), scorer)).to_pylist()
    assert got[5]["score"] == got[7]["score"]
    for t, out in zip(texts, got):
        words = words_of(t)
        spelled = [spell(w) for w in words]
        within, kind = score_streams(model, np.concatenate(spelled), np.array([0]))
        score, at = 0.0, 0
        for w, ids in zip(words, spelled):
            if counts[w]:
                score += within[at] + math.log(counts[w]) - of_class[model.classes.of[ids[0]]] + math.log(0.97)
            else:
                before = [11, *model.classes.of[ids[:-1]]]
                score += math.log(0.03) + sum(within[at + k] + table[before[k], i] + (kind[at + k] if k else 0) for k, i in enumerate(ids)) + kind[at + len(ids)]
            at += len(ids)
        base = sum(math.log10((counts[w] + 1) / (sum(counts.values()) + len(counts) + 1)) for w in words)
        assert (out["n_tokens"], out["n_known"]) == (len(words), sum(counts[w] > 0 for w in words))
        assert out["score"] == pytest.approx(score / math.log(10), abs=1e-4) and out["base_score"] == pytest.approx(base, abs=1e-9)
