"""Operators 1, 2, 5 and 7 against versions that share no code with them."""

import re
import sys
import zlib
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from strandline.llm import decontaminate, language_id, mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_languages_are_those_of_the_smallest_compressed_form(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    learned = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = {r["doc_id"]: r for r in language_id.identify(docs, learned).collect()}
    with_dict = [(lang, zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_dict_id=False, write_content_size=False)) for lang, body in learned]
    right = 0
    for i, text in rows.items():
        if not any(c.isalpha() for c in text or ""):
            assert by[i]["lang_pred"] == "und"
            continue
        plain = " ".join("".join(c if ord(c) > 127 or "a" <= c <= "z" else " " for c in text.lower()).split()).encode()
        sizes = {lang: sum(len(z.compress(plain[k : k + 2048])) for k in range(0, len(plain), 2048)) for lang, z in with_dict}
        least = min(sizes.values())
        assert sizes[by[i]["lang_pred"]] == least
        second = sorted(sizes.values())[1]
        assert by[i]["rejected"] == ((second - least) / least < 0.002)
    held = [r for r in docs.where(language_id.held_out(F.col("doc_id"))).collect()]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    known = [r for r in held if by[r["doc_id"]]["lang_pred"] != "und" and r["lang"]]
    right = sum(by[r["doc_id"]]["lang_pred"] == r["lang"] for r in known)
    assert right >= 0.9 * len(known)
    # Neither the language given nor the source is an input of a prediction.
    other = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", F.lit("zz")), learned).collect()}
    assert other == {i: r["lang_pred"] for i, r in by.items()}


def test_languages_of_repeated_and_unlabelled_texts(spark):
    rows = [(None, "alpha beta gamma delta " * 30, "xx"), (None, "alpha beta gamma delta " * 30, "xx"), (1, "uno dos tres cuatro cinco " * 30, "yy"), (2, "uno dos tres " * 30, None), (3, None, "yy")]
    learned = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert [lang for lang, _ in learned] == ["xx", "yy"]
    got = language_id.identify(spark.createDataFrame([(1, "gamma delta alpha"), (1, "gamma delta alpha"), (None, "tres cuatro dos")], "doc_id bigint, text string"), learned).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [(0, "yy"), (1, "xx"), (1, "xx")]


def plain_chain(texts, labels, judged, words):
    """A chain over given words: every category a smoothed word-count model with the ones before as a feature."""
    sets = [set(re.findall(r"[^\W_]+", (t or "").lower())) & words for t in texts]
    out, extra = [], [()] * len(texts)
    asked = [set(re.findall(r"[^\W_]+", (t or "").lower())) & words for t in judged]
    before = [()] * len(judged)
    for column in labels:
        yes, no = Counter(), Counter()
        for s, e, y in zip(sets, extra, column):
            (yes if y else no).update(s | {("before", k, v) for k, v in enumerate(e)})
        n_yes, n_no = sum(column), len(column) - sum(column)

        def odds(s):
            return np.log((n_yes + 0.5) / (n_no + 0.5)) + sum(np.log((yes[w] + 0.5) / (n_yes + 1)) - np.log((no[w] + 0.5) / (n_no + 1)) for w in s)

        got = [odds(s | {("before", k, v) for k, v in enumerate(e)}) > 0 for s, e in zip(asked, before)]
        before = [(*e, g) for e, g in zip(before, got)]
        extra = [(*e, bool(y)) for e, y in zip(extra, column)]
        out.append(got)
    return out


def test_toxicity_on_held_out_texts_is_better_than_a_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low"), "toxic")
    known = {r["doc_id"]: (r["low"], r["toxic"]) for r in labels.collect()}
    learn, test = ([i for i in sorted(known) if (i % 3 == 0) == k] for k in (False, True))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"), ["low", "toxic"])
    got = {r["doc_id"]: r for r in toxicity.classify(docs, chain).collect()}
    mine = [got[i]["toxic"] for i in test]
    words = {w.decode() for w in chain.vocabulary}
    plain = plain_chain([text[i] for i in learn], [[known[i][k] for i in learn] for k in (0, 1)], [text[i] for i in test], words)[1]
    truth = [bool(known[i][1]) for i in test]
    right = lambda said: sum(a == b for a, b in zip(said, truth)) / len(truth)
    assert right(mine) >= 0.9 and right(mine) > right(plain)
    assert sum(a and not b for a, b in zip(mine, truth)) <= 0.02 * len(truth)  # clean ones are left alone


def test_rare_features_weigh_alike_in_folds_and_in_the_end(spark, monkeypatch):
    seen = []
    plain = toxicity.fit_one

    def fit(x, extra, y, weight, size, config):
        w = plain(x, extra, y, weight, size, config)
        seen.append((weight, w))
        return w

    monkeypatch.setattr(toxicity, "fit_one", fit)
    rows = [(i, f"common words here {'awful' if i % 5 == 0 else 'kind'} u{chr(97 + i // 4)}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), int(i % 5 == 0)) for i in range(60)], "doc_id bigint, low int, toxic int")
    config = toxicity.ToxicityConfig(sample=20, folds=2, steps=20, min_documents=4)
    chain = toxicity.train(d, labels, ["low", "toxic"], config)
    assert len(seen) == 2 * (config.folds + 1)
    # A word of four documents, of which the sample has fewer, has one weight in all models of a category.
    few = [k for w, k in chain.vocabulary.items() if w.startswith(b"u") and len(w) == 2]
    for number in (0, 1):
        of = seen[number * 3 : number * 3 + 3]
        alike = [k for k in few if len({float(w[k]) for _, w in of}) == 1]
        assert len(few) == 15 and len(alike) >= 13
    # The words of documents without a label are not needed, whichever way they are left out.
    again = toxicity.train(d, labels, ["low", "toxic"], toxicity.ToxicityConfig(sample=20, folds=2, steps=20, min_documents=2, broadcast_labels=0))
    assert again.vocabulary == chain.vocabulary


def test_labels_repeat_for_one_id(spark):
    rows = [(i, f"some plain text {'vile' if i % 3 == 0 else 'fine'}") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)] * 2 + [(0, 0), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.classify(d, toxicity.train(d, labels, ["toxic"])).collect()
    assert {r["doc_id"] for r in got if r["toxic"]} == {i for i in range(30) if i % 3 == 0}


def test_window_sets_take_the_memory_that_is_stated():
    r = np.random.default_rng(0)
    items = [(i, " ".join(f"w{w}" for w in r.integers(0, 5000, 400)).encode()) for i in range(250)]
    made = decontaminate.WindowSet(items, 13)
    (n, hashes, words, of, owners), = made.by_length
    held = hashes.nbytes + words.nbytes + of.nbytes + owners.nbytes
    assert n == 13 and held <= 76 * len(hashes) and len(hashes) > 90_000
    assert sum(map(sys.getsizeof, made.number)) + sys.getsizeof(made.number) <= 130 * len(made.number)
    # Windows of several items, and of items without an id.
    both = decontaminate.WindowSet([(1, b"a b"), (2, b"a b"), (None, b"a b"), (None, b"c d"), (2, b"a b")], 13)
    (_, mask, found, _), = both.scan([b"x a b c d"])
    assert mask.tolist() == [False, True, True, True, True] and found == {"1", "2"}


def test_spans_are_taken_out_of_texts(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two THREE, then more.", "k"), (2, None, "k"), (3, "clean", "k"), (None, "one, two three", "k")], "doc_id bigint, text string, key string")
    bench = spark.createDataFrame([(7, "one two three")], "item_id bigint, text string")
    got = decontaminate.without_spans(docs, bench)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, ""), (1, "Keep this. , then more."), (2, None), (3, "clean")]


def test_rows_without_an_id_are_chosen_one_by_one(spark, tmp_path):
    rows = [(None, f"a b c d {i}", "en", "s") for i in range(40)] + [(5, "a b c d e", "en", "s")] * 2 + [(6, None, "en", "s")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    config = mixing.MixConfig(budget_num=1, budget_den=2, max_epochs=1)
    got = mixing.chosen_documents(docs, config)
    texts = [r["text"] for r in got.collect()]
    tokens = sum(len((t or "").split()) for t in texts)
    assert got.columns == docs.columns and 100 <= tokens <= 42 * 5 // 2 and len(texts) == len(mixing.mix(docs, config).collect())
