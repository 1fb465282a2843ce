"""Identity graphs: ambiguity, components with and without vetoes, chains of corrections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .checkpoint import cut


@dataclass(frozen=True)
class EdgeConfig:
    accept: float = 0.78
    margin: float = 0.08


def demote_ambiguous(edges: DataFrame, config: EdgeConfig = EdgeConfig()) -> DataFrame:
    """``edges``: (pred, succ, score, state). Where a node's best two accepted-or-review scores are
    closer than the margin, every accepted edge within the margin of the best goes to review."""
    out = edges
    for side in ("pred", "succ"):
        w = Window.partitionBy(side)
        by = w.orderBy(F.desc("score"), "pred", "succ")
        out = out.withColumns({f"best_{side}": F.max("score").over(w), f"second_{side}": F.nth_value("score", 2).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    close = F.lit(False)
    for side in ("pred", "succ"):
        best, second = F.col(f"best_{side}"), F.col(f"second_{side}")
        close = close | (second.isNotNull() & (best - second < config.margin) & (best - F.col("score") < config.margin))
    return out.select("pred", "succ", "score", F.when((F.col("state") == "accepted") & close, "review").otherwise(F.col("state")).alias("state"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): smallest node reachable, by rounds of smallest neighbours with shortcuts."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        seen = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("m"))
        near = labels.join(seen, labels["node"] == seen["u"]).select("node", F.least("component", "m").alias("component"))
        up = near.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        new = cut(near.join(up, near["component"] == up["n2"], "left").select("node", F.least("component", F.coalesce("c2", "component")).alias("component")))
        moved = new.join(labels.withColumnRenamed("component", "was"), "node").where(F.col("component") != F.col("was"))
        if moved.isEmpty():
            return new
        labels = new


def components_with_veto(edges: DataFrame, nodes: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Per scene: edges by score (then ends) join groups, unless the group would hold two different
    values of an attribute. The order decides, so each scene is folded in one task; it holds the nodes, and the
    edges stream through. An edge inside a group or between groups that differ changes nothing, now or later,
    so whole batches of such are passed over at once.

    ``edges``: (key, pred, succ, score); ``nodes``: (key, node, attributes). Gives (key, node, component).
    """
    schema = f"{key} {nodes.schema[key].dataType.simpleString()}, node {nodes.schema['node'].dataType.simpleString()}, component {nodes.schema['node'].dataType.simpleString()}"
    out = to_arrow_schema(StructType.fromDDL(schema))
    none = lambda c: F.lit(None).cast(edges.schema[c].dataType).alias(c)
    own = nodes.select(key, F.lit(False).alias("edge"), F.col("node").alias("pred"), none("succ"), none("score"), *attributes)
    links = edges.select(key, F.lit(True).alias("edge"), "pred", "succ", "score", *(F.lit(None).cast(nodes.schema[a].dataType).alias(a) for a in attributes))

    class Scene:
        def __init__(self, value: object) -> None:
            self.value, self.told, self.index = value, [], None

        def start(self) -> None:
            rows = pd.concat(self.told, ignore_index=True) if self.told else pd.DataFrame({c: [] for c in ("pred", *attributes)})
            self.names, self.index = rows["pred"], pd.Index(rows["pred"].unique())
            first = rows.drop_duplicates("pred", keep="last").set_index("pred").loc[self.index]
            self.label = np.arange(len(self.index))
            self.members = [[i] for i in range(len(self.index))]
            self.known = [pd.factorize(first[a])[0] for a in attributes]  # -1: unknown

        def differ(self, x, y):
            return np.any([(k[x] >= 0) & (k[y] >= 0) & (k[x] != k[y]) for k in self.known], axis=0) if self.known else np.zeros(np.shape(x), bool)

        def join(self, pred: pd.Series, succ: pd.Series) -> None:
            p, s = self.index.get_indexer(pred), self.index.get_indexer(succ)
            if (p < 0).any() or (s < 0).any():
                raise KeyError("an edge of a node that is not given")
            for at in range(0, len(p), 1024):
                i, j = p[at : at + 1024], s[at : at + 1024]
                x, y = self.label[i], self.label[j]
                for k in np.flatnonzero((x != y) & ~self.differ(x, y)):
                    a, b = self.label[i[k]], self.label[j[k]]
                    if a == b or self.differ(a, b):
                        continue
                    a, b = (a, b) if len(self.members[a]) >= len(self.members[b]) else (b, a)
                    self.label[self.members[b]] = a
                    self.members[a] += self.members[b]
                    self.members[b] = []
                    for known in self.known:
                        known[a] = max(known[a], known[b])

        def groups(self) -> pa.RecordBatch:
            if self.index is None:
                self.start()
            least = pd.Series(self.index).groupby(self.label).transform("min").to_numpy() if len(self.index) else np.array([])
            found = least[self.index.get_indexer(self.names)] if len(self.index) else []
            columns = ([self.value] * len(self.names), self.names.tolist(), list(found))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene = None
        for batch in batches:
            rows = batch.to_pandas()
            for part in np.split(np.arange(len(rows)), np.flatnonzero(((rows[key] != rows[key].shift()) & ~(rows[key].isna() & rows[key].shift().isna()))[1:]) + 1):
                if not len(part):
                    continue
                value, own_rows = batch[key][int(part[0])].as_py(), rows.iloc[part]
                if scene is None or scene.value != value:
                    if scene is not None:
                        yield scene.groups()
                    scene = Scene(value)
                is_edge = own_rows["edge"].to_numpy(bool)
                if not is_edge.all():
                    scene.told.append(own_rows.loc[~is_edge, ["pred", *attributes]])
                if is_edge.any():
                    if scene.index is None:
                        scene.start()
                    scene.join(own_rows.loc[is_edge, "pred"], own_rows.loc[is_edge, "succ"])
        if scene is not None:
            yield scene.groups()

    return own.unionByName(links).repartition(key).sortWithinPartitions(key, "edge", F.desc("score"), "pred", "succ").mapInArrow(task, schema)


def weighted_mean_vectors(vectors: DataFrame, by: str, weight: str) -> DataFrame:
    """Weighted mean of each key's vectors, made a unit vector again."""
    parts = vectors.select(by, F.col(weight).alias("w"), F.posexplode("v").alias("i", "c"))
    means = parts.groupBy(by, "i").agg((F.sum(F.col("w") * F.col("c")) / F.sum("w")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(by)))
    return means.select(by, "i", (F.col("m") / length).alias("value"))


def terminal_targets(spark: SparkSession, merges: DataFrame) -> DataFrame:
    """(source, target) chains followed to their end by doubling; a cycle makes the job fail: no
    chain is longer than there are merges."""
    now = merges.select("source", "target")
    most = now.count()
    steps = 1
    while True:
        nxt = now.select(F.col("source").alias("s2"), F.col("target").alias("t2"))
        joined = now.join(nxt, now["target"] == nxt["s2"], "left")
        joined = joined.select("source", F.coalesce("t2", "target").alias("target"), F.col("t2").isNotNull().alias("moved"))
        joined = cut(joined)
        if joined.where("moved").isEmpty():
            return joined.select("source", "target")
        if steps >= most:  # what moved goes on beyond ``steps`` merges
            raise ValueError("the chain of merges has a cycle")
        steps *= 2
        now = joined.select("source", "target")
