"""Mixing sources to target weights: budgets flow down a domain-language-source tree.

At each node the budget is dealt to the children by weight; a child never gets more than its
subtree can give (tokens times ``max_epochs``) and what it lacks goes to its siblings by weight.
Since a node never gets more than its subtree holds, a shortage reaches an ancestor's other
children only when all siblings are full. Each leaf then takes whole epochs and a token-prefix
of one more epoch, in an order seeded by (seed, epoch, doc_id).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, materialize

#: Only the 1/65536 of a leaf in which its prefix ends is sorted: two rounds of two hex digits.
LEVELS, DIGITS = 2, 2


@dataclass(frozen=True)
class MixConfig:
    """Weights are whole numbers; what is not named has weight 1; weight 0 takes nothing.

    The budget is ``budget_num / budget_den`` of all tokens.
    """

    domain_weights: dict[str, int] = field(default_factory=dict)
    lang_weights: dict[str, int] = field(default_factory=dict)
    source_weights: dict[str, int] = field(default_factory=dict)
    budget_num: int = 3
    budget_den: int = 5
    max_epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """Domains of the synthetic tables, which have none: by the first hex digit of md5(source)."""
    h = F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)
    return F.when(h < "4", "d0").when(h < "8", "d1").when(h < "c", "d2").otherwise("d3")


def _weight(col: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def water_fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Deal ``parent_budget`` among the rows of a parent by ``w``, none above its ``cap``.

    With children sorted by cap/w, a child is full iff the level that all unfilled children
    would share reaches its ratio; that is a prefix, so running sums decide it.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy()
    run = by.orderBy(F.col("cap").cast("double") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    left = (F.col("parent_budget") - F.coalesce(F.sum("cap").over(run), F.lit(0))).cast("double")
    weight = (F.sum("w").over(by) - F.coalesce(F.sum("w").over(run), F.lit(0))).cast("double")
    return (
        nodes.where(F.col("w") > 0)
        .withColumns({"left_": left, "weight_": weight})
        .withColumn("full_", F.col("cap") * F.col("weight_") <= F.col("left_") * F.col("w"))
        .withColumn("level_", F.max(F.when(~F.col("full_"), F.col("left_") / F.col("weight_"))).over(by))
        .withColumn("budget", F.when(F.col("full_"), F.col("cap")).otherwise(F.floor(F.col("w") * F.col("level_"))))
        .drop("left_", "weight_", "full_", "level_")
    )


def leaf_budgets(leaves: DataFrame, total: DataFrame, config: MixConfig) -> DataFrame:
    """``leaves``: (domain, lang, source, tokens). Adds ``budget`` to each."""
    cap = (F.sum("tokens") * config.max_epochs).alias("cap")
    top = leaves.groupBy("domain").agg(cap).withColumn("w", _weight(F.col("domain"), config.domain_weights)).withColumn("key", F.col("domain"))
    top = water_fill(top.crossJoin(total), [])  # total is one row
    mid = leaves.groupBy("domain", "lang").agg(cap).withColumn("w", _weight(F.col("lang"), config.lang_weights)).withColumn("key", F.col("lang"))
    mid = water_fill(mid.join(top.select("domain", F.col("budget").alias("parent_budget")), "domain"), ["domain"])
    low = leaves.withColumn("cap", F.col("tokens") * config.max_epochs).withColumn("w", _weight(F.col("source"), config.source_weights)).withColumn("key", F.col("source"))
    low = water_fill(low.join(mid.select("domain", "lang", F.col("budget").alias("parent_budget")), ["domain", "lang"]), ["domain", "lang"])
    return low.select("domain", "lang", "source", "tokens", "budget")


def mix(docs: DataFrame, config: MixConfig = MixConfig(), domain: Column | None = None, row: str | None = None) -> DataFrame:
    """The chosen rows: doc_id, domain, lang, source, n_tokens, copies (how many epochs hold it), and the
    column ``row`` where one is named; it settles ties between rows with one id.

    Tokens are words without ASCII white space; null text has none. Null lang or source counts
    as ''. Repeated rows each count. Budgets are rounded down to whole tokens, and a prefix ends
    before the document that would pass its budget. An empty table gives no rows. Rows without
    tokens come with every epoch of their leaf that reaches them. Other columns are ignored.
    """
    narrow = docs.select(
        "doc_id",
        (domain_of(F.col("source")) if domain is None else domain).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPACED_WORD)).cast("long").alias("n_tokens"),
        *([] if row is None else [F.col(row)]),
    )
    narrow = materialize(narrow, "mix-narrow")
    leaf = ["domain", "lang", "source"]
    leaves = narrow.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    # Never more than the whole tree can give: the top level is water-filled by this too.
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * config.budget_num / F.lit(config.budget_den)).cast("long").alias("parent_budget"))
    plan = materialize(leaf_budgets(leaves, total, config), "mix-leaves").select(
        *leaf,
        F.coalesce(F.expr("try_divide(budget, tokens)"), F.lit(0)).cast("long").alias("epochs"),
        F.coalesce(F.expr("try_mod(budget, tokens)"), F.lit(0)).alias("rest"),
    )
    key = F.md5(F.concat_ws(":", F.lit(str(config.seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    dealt = narrow.join(plan, leaf).withColumn("key", key)
    # Where the prefix ends: the first range of keys whose end passes the rest, two digits at a time.
    ends = plan.select(*leaf, F.lit("").alias("cut"), F.lit(0).cast("long").alias("cut_before"))
    for level in range(1, LEVELS + 1):
        inside = dealt.join(ends, leaf).where(F.col("key").startswith(F.col("cut"))).withColumn("range", F.substring("key", 1, DIGITS * level))
        sums = inside.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"), F.max("cut_before").alias("base"))
        before = F.col("base") + F.coalesce(F.sum("t").over(Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        passed = sums.withColumn("before", before).where(F.col("before") + F.col("t") > F.col("rest"))
        ends = passed.groupBy(*leaf).agg(F.min("range").alias("cut"), F.min_by("before", "range").alias("cut_before"))
        ends = materialize(ends, "mix-ends")
    placed = dealt.join(ends, leaf, "left").withColumn("range", F.substring("key", 1, DIGITS * LEVELS))
    whole = placed.where(F.col("cut").isNull() | (F.col("range") != F.col("cut"))).withColumn("more", (F.col("cut").isNull() | (F.col("range") < F.col("cut"))).cast("long"))
    run = Window.partitionBy(*leaf).orderBy("key", "doc_id", "n_tokens", *([] if row is None else [row])).rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(F.col("range") == F.col("cut")).withColumn("more", (F.col("cut_before") + F.sum("n_tokens").over(run) <= F.col("rest")).cast("long"))
    return (
        whole.unionByName(edge)
        .select("doc_id", *leaf, "n_tokens", (F.col("epochs") + F.col("more")).alias("copies"), *([] if row is None else [row]))
        .where(F.col("copies") > 0)
    )


def chosen_documents(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The rows of ``docs`` that ``mix`` chooses, once each, with all their columns.

    Rows are numbered by their place in the table and joined back by that, so rows without an id and rows
    that share one are chosen one by one. ``docs`` must give its rows in the same partitions each time that
    it is read, as a written table does.
    """
    inside = docs.select(F.struct("*").alias("row_"), F.monotonically_increasing_id().alias("place_"))
    chosen = mix(inside.select("row_.*", F.col("place_").alias("mix_place_")), config, row="mix_place_").select(F.col("mix_place_").alias("place_"))
    return inside.join(chosen, "place_", "left_semi").select("row_.*")


def mix_sql(config: MixConfig, documents: str = "documents") -> str:
    """The same as one DuckDB query."""

    def weight(col: str, weights: dict[str, int]) -> str:
        return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"

    def fill(name: str, source: str, parent: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        run = f"OVER ({part} ORDER BY cap::DOUBLE / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return f"""
{name}_a AS (SELECT *, (parent_budget - coalesce(sum(cap) {run}, 0))::DOUBLE AS left_, (sum(w) OVER ({part}) - coalesce(sum(w) {run}, 0))::DOUBLE AS weight_ FROM ({source}) WHERE w > 0),
{name}_b AS (SELECT *, cap * weight_ <= left_ * w AS full_ FROM {name}_a),
{name}_c AS (SELECT *, max(CASE WHEN NOT full_ THEN left_ / weight_ END) OVER ({part}) AS level_ FROM {name}_b),
{name} AS (SELECT *, CASE WHEN full_ THEN cap::BIGINT ELSE floor(w * level_)::BIGINT END AS budget FROM {name}_c)"""

    e = config.max_epochs
    return f"""
WITH narrow_ AS (
  SELECT doc_id, substr(md5(coalesce(source, '')), 1, 1) AS h, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {documents}),
narrow AS (SELECT doc_id, CASE WHEN h < '4' THEN 'd0' WHEN h < '8' THEN 'd1' WHEN h < 'c' THEN 'd2' ELSE 'd3' END AS domain, lang, source, n_tokens FROM narrow_),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM narrow GROUP BY ALL),
total AS (SELECT floor(sum(tokens) * {config.budget_num} / {config.budget_den})::BIGINT AS parent_budget FROM leaves),
{fill('top', f"SELECT domain, domain AS key, (sum(tokens) * {e})::BIGINT AS cap, {weight('domain', config.domain_weights)} AS w, any_value(parent_budget) AS parent_budget FROM leaves, total GROUP BY domain", '')},
{fill('mid', f"SELECT l.domain, l.lang, l.lang AS key, (sum(tokens) * {e})::BIGINT AS cap, {weight('l.lang', config.lang_weights)} AS w, any_value(t.budget) AS parent_budget FROM leaves l JOIN top t USING (domain) GROUP BY l.domain, l.lang", 'domain')},
{fill('low', f"SELECT l.domain, l.lang, l.source, l.source AS key, tokens, tokens * {e} AS cap, {weight('l.source', config.source_weights)} AS w, m.budget AS parent_budget FROM leaves l JOIN mid m USING (domain, lang)", 'domain, lang')},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM low),
run AS (SELECT n.*, p.epochs, p.rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{config.seed}:', p.epochs, ':', doc_id)), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM narrow n JOIN plan p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, (epochs + (upto <= rest)::BIGINT)::BIGINT AS copies FROM run WHERE epochs + (upto <= rest)::BIGINT > 0"""
