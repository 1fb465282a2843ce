"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic regressions over the presence of chosen
words; each later model also sees the log-odds that the earlier ones gave. While training, those
log-odds are out-of-fold: a row's come from models that did not see it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unless_named

#: Words are runs of ASCII letters and characters beyond ASCII, lower-cased.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class ToxicityConfig:
    #: Bound of the training sample: the labelled rows with the smallest hash of their id.
    sample: int = 20_000
    #: Words kept as features for each category: the most informative ones of all labelled rows.
    features: int = 3000
    #: A feature occurs in at least so many labelled documents.
    min_documents: int = 4
    folds: int = 5
    l2: float = 1e-3
    steps: int = 300
    threshold: float = 0.5
    #: Labelled ids that may be broadcast, to make the words of labelled documents only.
    broadcast_labels: int = 1_000_000


def words_of(text: str | None) -> set[bytes]:
    return set(text.lower().encode().translate(_TABLE).split()) if text else set()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text with its labels, summed for the batch."""
    for batch in batches:
        labels = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], dtype=np.float64)
        sums: dict[bytes, np.ndarray] = {}
        one = np.vstack([np.ones(batch.num_rows), labels]).T
        for text, row in zip(batch.column(0).to_pylist(), one):
            for w in words_of(text):
                got = sums.get(w)
                if got is None:
                    sums[w] = row.copy()
                else:
                    got += row
        if sums:
            m = np.array(list(sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in sums], pa.string()), *(pa.array(m[:, k].astype(np.int64)) for k in range(m.shape[1]))], names=["word", "n", *(f"c{k}" for k in range(m.shape[1] - 1))])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [b" ".join(sorted(words_of(t))).decode() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string())], names=["doc_id", "text"])


def choose_features(labelled: DataFrame, categories: list[str], config: ToxicityConfig) -> dict[str, list[float]]:
    """For each category the words whose presence tells most about it (G statistic) in all rows of
    ``labelled``; each with its log-odds ratio for every category."""
    given = labelled.select("text", *[F.col(c).cast("int").alias(c) for c in categories])
    counts = given.mapInArrow(_words, "word string, n bigint, " + ", ".join(f"c{k} bigint" for k in range(len(categories))))
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(categories))]).where(F.col("n") >= config.min_documents)
    totals = given.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in categories]).first()
    counts = materialize(counts, "words")
    chosen: dict[str, list[float]] = {}

    def odds(r) -> list[float]:
        of = [(r[f"c{j}"], totals[d] or 0) for j, d in enumerate(categories)]
        return [float(np.log((yes + 0.5) / (all_yes + 1)) - np.log((r["n"] - yes + 0.5) / (totals["n"] - all_yes + 1))) for yes, all_yes in of]

    for k, c in enumerate(categories):

        def part(seen: Column, expected: Column) -> Column:
            return F.when(seen > 0, seen * F.ln(seen / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

        rate = (totals[c] or 0) / max(1, totals["n"])
        yes, n = F.col(f"c{k}").cast("double"), F.col("n").cast("double")
        g = part(yes, n * rate) + part(n - yes, n * (1 - rate))
        for r in counts.withColumn("g", g).orderBy(F.desc("g"), "word").limit(config.features).collect():
            chosen.setdefault(r["word"], odds(r))
    return chosen


class Sparse:
    """Rows of feature numbers, for sums over them."""

    def __init__(self, rows: list[list[int]]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], dtype=np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, v: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, weights=v[self.row], minlength=size)


def fit_one(x: Sparse, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, config: ToxicityConfig) -> np.ndarray:
    """Logistic regression by Adam on the whole sample; weights of features, extras and the constant."""
    w = np.zeros(size + extra.shape[1] + 1)
    total = max(1.0, weight.sum())
    rate = np.clip((weight * y).sum() / total, 1e-4, 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, config.steps + 1):
        z = x.dot(w[:size]) + extra @ w[size:-1] + w[-1]
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        g = np.concatenate([x.back(d, size), extra.T @ d, [d.sum()]])
        g[:-1] += config.l2 / 10 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[bytes, int]
    models: list[np.ndarray]

    def log_odds(self, x: Sparse) -> np.ndarray:
        size = len(self.vocabulary)
        extra = np.zeros((x.n, 0))
        for w in self.models:
            z = x.dot(w[:size]) + extra @ w[size:-1] + w[-1]
            extra = np.column_stack([extra, np.clip(z, -30, 30)])
        return extra

    def rows(self, texts: list[str | None]) -> Sparse:
        number, known = self.vocabulary, self.vocabulary.keys()
        return Sparse([[number[w] for w in known & words_of(t)] for t in texts])


def train(docs: DataFrame, labels: DataFrame, categories: list[str], config: ToxicityConfig = ToxicityConfig()) -> Chain:
    """``labels``: doc_id and a 0/1 column per category; rows with a null label are not used.

    Features come from all labelled rows, for which each document's distinct words are shuffled once.
    The sample for the fit is chosen among the labels' ids, without texts; its rows, bounded by
    ``sample``, are broadcast to fetch their texts. Where an id has several texts, the fit takes the one
    with the smallest hash. Copies of a text stand in one fold. A feature too rare in the sample to be fitted has
    its log-odds ratio in all labelled rows as its weight.
    """
    for c in categories:
        labels = labels.where(F.col(c).isNotNull())
    chosen = labels.select("doc_id", F.xxhash64("doc_id").alias("h"), *[F.col(c).cast("int").alias(c) for c in categories]).orderBy("h", *categories).limit(config.sample)
    chosen = materialize(chosen, "chosen")
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    one = texts.select("doc_id", "t").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"))
    found = texts.join(F.broadcast(one), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])
    labelled = materialize(found.join(F.broadcast(chosen), "doc_id"), "labelled")  # as many rows as the sample at most
    ids = materialize(labels.select("doc_id").distinct(), "labelled-ids")
    if ids.count() <= config.broadcast_labels:  # else the words of all documents are made and joined
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    words = docs.select("doc_id", "text").mapInArrow(_distinct, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
    features = choose_features(words.join(labels.select("doc_id", *categories), "doc_id"), categories, config)
    ratios = np.array(list(features.values())).reshape(len(features), len(categories))
    vocabulary = {w.encode(): i for i, w in enumerate(features)}
    chain = Chain(categories, vocabulary, [])
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(chain)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in batches:
            rows = [sorted(made.vocabulary[w] for w in made.vocabulary.keys() & words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32())), *batch.columns[2:]], names=["h", "x", "t", *(f"c{k}" for k in range(len(categories)))])

    labels_of = [F.col(c).alias(f"c{k}") for k, c in enumerate(categories)]
    got = labelled.select("h", "text", "t", *labels_of).mapInArrow(numbered, "h bigint, x array<int>, t bigint" + "".join(f", c{k} int" for k in range(len(categories)))).toPandas()
    got = got.sort_values(["h", "t", *(f"c{k}" for k in range(len(categories)))])
    x, size = Sparse([list(r) for r in got["x"]]), len(vocabulary)
    rare = np.bincount(x.col, minlength=size) < config.min_documents
    fold = got["t"].to_numpy(dtype=np.int64) % config.folds
    extra = np.zeros((x.n, 0))
    for number, c in enumerate(categories):
        y = got[f"c{number}"].to_numpy(dtype=np.float64)
        unseen = np.zeros(x.n)
        for k in range(config.folds):
            w = fit_one(x, extra, y, (fold != k).astype(np.float64), size, config)
            w[:size][rare] = ratios[rare, number]  # as in the final model, so that later categories learn from its scale
            z = x.dot(w[:size]) + extra @ w[size:-1] + w[-1]
            unseen[fold == k] = np.clip(z, -30, 30)[fold == k]
        w = fit_one(x, extra, y, np.ones(x.n), size, config)
        w[:size][rare] = ratios[rare, number]
        chain.models.append(w)
        extra = np.column_stack([extra, unseen])
    return chain


def classify(docs: DataFrame, chain: Chain, config: ToxicityConfig = ToxicityConfig(), keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row (doc_id), then p_<category> for each, then ``toxic``: the last
    category's probability reaches the threshold. Null and empty texts have no words and get the
    base rate. Every row is judged, over its whole text; a kept column with the name of a result gives
    way to it, other columns are ignored."""
    keep = unless_named(keep or ["doc_id"], ["toxic", *(f"p_{c}" for c in chain.categories)])
    key = F.struct(*keep).alias("key")
    kind = docs.select(key).schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: Chain = shared.value
        for batch in batches:
            p = 1 / (1 + np.exp(-made.log_odds(made.rows(batch.column(1).to_pylist()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=["key", *(f"p_{c}" for c in made.categories)])

    found = docs.select(key, "text").mapInArrow(judged, f"key {kind}, " + ", ".join(f"p_{c} double" for c in chain.categories))
    return found.select("key.*", *[f"p_{c}" for c in chain.categories], (F.col(f"p_{chain.categories[-1]}") >= config.threshold).alias("toxic"))
