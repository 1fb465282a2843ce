"""Each stage of the pipeline, on its own input, against a plain version."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strandline.llm import decontaminate, language_id, mixing, partenum

from .test_edges import brute_components, brute_contamination

WORDS = {"en": "the of and house river green walking thought never again people water".split(), "de": "der die und Haus Fluß grün gehen Gedanke niemals wieder Leute Wasser".split()}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = np.random.default_rng(3)
    make = lambda lang, n: " ".join(r.choice(WORDS[lang], n))
    items = [(i, make("en", 20)) for i in range(4)] + [(9, None)]
    rows = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        text = make(lang, int(r.integers(20, 120)))
        if i % 10 == 1:
            text += " " + items[i % 4][1]
        rows.append([i, text, lang, f"s{i % 5}"])
    for i in range(20):  # near and exact copies
        words = rows[i][1].split()
        words[3] = "changed" if i % 2 else words[3]
        rows.append([200 + i, " ".join(words), rows[i][2], "s9"])
    rows += [[300, None, "en", "s1"], [301, "", None, None], [302, "123 456 !!", "en", "s1"], [0, rows[0][1], rows[0][2], "s0"]]
    out = tmp_path_factory.mktemp("tables")
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).assign(n_chars=lambda d: d.text.str.len().astype("Int64")).to_parquet(out / "documents.parquet")
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(out / "benchmark.parquet")
    return out, items


def brute_stage(name, rows, items):
    if name == "ngram_jaccard":
        config = partenum.JoinConfig(words=5, num=80, den=100)
        first = {}
        for r in rows:
            first.setdefault(r["doc_id"], r)
        ids = list(first)
        comp = brute_components(ids, [partenum.shingles(None if first[i]["text"] is None else first[i]["text"].encode(), config) for i in ids], config)
        return {i for i in ids if comp[i] == i}
    if name == "decontaminate":
        keep = set()
        for r in rows:
            n, hit, _ = brute_contamination(r["text"], items)
            if not (hit > 0 and 20 * hit >= n):
                keep.add(r["doc_id"])
        return keep
    if name == "mix_sources":
        docs = pd.DataFrame([r.asDict() for r in rows])  # noqa: F841
        return {r[0] for r in duckdb.sql(mixing.mix_sql(corpus_pipeline.MIX, "docs")).fetchall()}
    return None


def test_stages(spark, folder):
    out, items = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        got = stage(spark, docs, str(out)).cache()
        if name == "token_store":
            start, expect = 0, []
            for r in sorted(rows, key=lambda r: r["doc_id"]):
                ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [2], dtype="<u4")
                expect.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
            assert sorted(map(tuple, got.collect())) == expect
            break
        assert got.columns == docs.columns
        kept = got.collect()
        assert kept and set(map(tuple, kept)) <= set(map(tuple, rows))
        if name == "language_id":
            learned = language_id.train(docs.where(~language_id.held_out(docs["doc_id"])))
            sizes = language_id.Sizes(learned, language_id.LanguageConfig())
            good = lambda x: bool(x) and any(c.isalpha() for c in x) and sizes.predict(x)[2] >= 0.002  # noqa: B023, E731
            assert sorted(map(str, map(tuple, kept))) == sorted(str(tuple(r)) for r in rows if good(r["text"]))
        else:
            assert sorted(r["doc_id"] for r in kept) == sorted(brute_stage(name, rows, items)), name
        assert len(kept) < len(rows)
        docs = got
    assert corpus_pipeline.run(spark, str(out)).count() == len(expect)


def test_empty_tables(spark, folder, tmp_path):
    out, _ = folder
    spark.read.parquet(f"{out}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{out}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decontaminate.WindowSet([], 13).by_length == []


def test_the_pipeline_keeps_fewer_encoded_words_than_the_store_alone(monkeypatch):
    given = []
    monkeypatch.setattr(corpus_pipeline.token_store, "write", lambda docs, path, config=corpus_pipeline.token_store.TokenStoreConfig(): given.append(config))
    monkeypatch.setattr(corpus_pipeline.token_store, "read", lambda shards: shards)
    corpus_pipeline.token_shards(None, None, "")
    assert given[0].cached_words * 2 <= corpus_pipeline.token_store.TokenStoreConfig().cached_words
