"""Quality rules judged by host: a document goes for its own failures or for its host's.

Every document's text is measured by DataFrame expressions in its own row. Failures of each rule are
counted by host, before they are shuffled. A host's failure rate is drawn towards that of all hosts by a
beta prior, whose mean and strength come from the hosts' own rates (moments of the beta-binomial), so a
host of few documents is not judged by them alone. A host fails by a rule when even the lower end of its
rate, so drawn, is over the rule's limit; the verdicts of failing hosts are joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class HostConfig:
    min_words: int = 50
    #: Percent of the words that repeated windows may cover.
    max_repeat: int = 50
    #: Rules that count for the host only: symbols and repeated lines in percent of words and of lines, mean word length.
    max_symbols: int = 10
    max_dup_lines: int = 30
    word_length: tuple[int, int] = (2, 15)
    #: A host fails by a rule that more than this share of its documents break, so many standard deviations clear of it.
    limit: float = 0.5
    deviations: float = 2.0
    #: Least correlation of two documents of a host that the prior takes: its strength is at most the inverse.
    min_correlation: float = 1e-4
    #: Failing hosts whose verdicts may be broadcast; beyond that they are joined by a shuffle.
    broadcast_hosts: int = 100_000


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value computed once however often ``of`` uses it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def words(text: Column) -> Column:
    """Runs without ASCII white space, in order."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def repeat_words(words: Column, window: int = 3) -> Column:
    """Words inside windows of so many words that stand in the text twice or more, the first included.

    Where all windows' hashes differ, no window is repeated. Else the windows themselves are sorted with
    their places, so equal ones are neighbours, whatever their hashes; the places of repeated ones in order
    tell how many words they cover together.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(window))))
    differ = _let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    places = F.sequence(F.lit(0), F.size(words) - window)
    text = lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(window)))
    windows = F.sort_array(F.transform(places, lambda i: F.struct(text(i).alias("text"), i.alias("at"))))

    def repeated(s: Column) -> Column:
        same = lambda w, k: F.coalesce(F.get(s, k)["text"] == w["text"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda w, k: same(w, k - 1) | same(w, k + 1)), lambda w: w["at"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= window, none).when(differ, none).otherwise(covered(_let(windows, repeated)))


def measures(text: Column) -> Column:
    """A struct of the measures of one text; a null text is an empty one.

    One expression whose parts are computed once, so the optimizer has no field to compute by itself.
    """

    def of(t: Column) -> Column:
        bare = lambda s: F.translate(s, " \t\n\x0b\x0c\r", "")
        lines = F.filter(F.split(t, "\n", -1), lambda line: bare(line) != "")
        return _let(
            F.struct(words(t).alias("words"), lines.alias("lines")),
            lambda x: F.struct(
                F.size(x["words"]).cast("long").alias("n_words"),
                F.length(bare(t)).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                F.size(x["lines"]).cast("long").alias("n_lines"),
                (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).cast("long").alias("n_dup_lines"),
                _let(x["words"], lambda w: repeat_words(w)).alias("n_repeat_words"),
            ),
        )

    return _let(F.coalesce(text, F.lit("")), of)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and, in a struct ``rule_measures``, the measures of each text."""
    return docs.withColumn("rule_measures", measures(F.col(text)))


def rules(m: Column, config: HostConfig) -> dict[str, Column]:
    """What each rule says of a document's measures: true where it fails."""
    n, (low, high) = m["n_words"], config.word_length
    return {
        "few_words": n < config.min_words,
        "repeated_words": 100 * m["n_repeat_words"] > config.max_repeat * n,
        "symbols": 100 * m["n_symbols"] > config.max_symbols * n,
        "repeated_lines": 100 * m["n_dup_lines"] > config.max_dup_lines * m["n_lines"],
        "word_length": (m["word_chars"] < low * n) | (m["word_chars"] > high * n),
    }


def base_failed(m: Column, config: HostConfig) -> Column:
    said = rules(m, config)
    return said["few_words"] | said["repeated_words"]


def host_rates(documents: DataFrame, config: HostConfig = HostConfig()) -> DataFrame:
    """One row per host and rule of ``documents`` (host, rule_measures): host, rule, n, failed, rate, low, fails.

    ``rate`` is the mean of the host's rate given its documents and the prior, ``low`` that many standard
    deviations below it. The prior's correlation is held between ``min_correlation`` and almost 1; where
    all hosts fail always or never, or there is one only, it is the least, so all of them have the common rate.
    Documents without a host are in no row.
    """
    counts = documents.where(F.col("host").isNotNull()).select("host", *(v.cast("long").alias(k) for k, v in rules(F.col("rule_measures"), config).items()))
    names = list(rules(F.col("rule_measures"), config))
    by_host = counts.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in names))
    long = by_host.select("host", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("failed")) for k in names))).alias("r")).select("host", "n", "r.*")
    # Sums over hosts; the numbers are integers below 2^53, so their sums do not depend on the order.
    all_ = long.groupBy("rule").agg(F.count("*").alias("hosts"), F.sum("n").alias("total"), F.sum("failed").alias("all_failed"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("ratio"))
    p, hosts, total = F.col("all_failed") / F.col("total"), F.col("hosts"), F.col("total").cast("double")
    within = p * (1 - p)
    between = F.col("ratio") - p * F.col("all_failed")  # sum over hosts of n * (rate - p)^2
    room = within * (total - F.col("squares") / total - (hosts - 1))
    found = F.when(room > 0, (between - within * (hosts - 1)) / room).otherwise(F.lit(config.min_correlation))
    correlation = F.least(F.greatest(found, F.lit(config.min_correlation)), F.lit(0.999))
    prior = all_.select("rule", p.alias("p"), ((1 - correlation) / correlation).alias("strength"))
    a, b = F.col("failed") + F.col("p") * F.col("strength"), F.col("n") - F.col("failed") + (1 - F.col("p")) * F.col("strength")
    rated = long.join(F.broadcast(prior), "rule").withColumn("rate", a / (a + b))  # one row for each rule
    rated = rated.withColumn("low", F.col("rate") - config.deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1)))
    return rated.select("host", "rule", "n", "failed", "rate", "low", (F.col("low") > config.limit).alias("fails"))


def _failing(rates: DataFrame, config: HostConfig) -> DataFrame:
    """host, host_rules of the hosts that fail: their rules in order; to be joined on host."""
    failing = materialize(rates.where("fails").groupBy("host").agg(F.sort_array(F.collect_set("rule")).alias("host_rules")), "failing-hosts")
    return F.broadcast(failing) if failing.count() <= config.broadcast_hosts else failing


def judge(docs: DataFrame, config: HostConfig = HostConfig(), key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of ``docs``: its key, host, measures, base_failed, host_rules and kept.

    A null or empty text has no words and fails. Documents without a host (null) are judged by themselves.
    Repeated rows each count and come out. Other columns are ignored; an empty table gives no rows. Texts
    of any length are measured whole, in their own row. ``host_rules`` are the rules that the host fails by,
    empty where it fails by none; ``kept`` is false where the document or its host fails.
    """
    rows = measured(docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text")), "text").select("key", "host", "rule_measures")
    rows = materialize(rows, "rule-measures")
    joined = rows.join(_failing(host_rates(rows, config), config), "host", "left")
    host_rules = F.coalesce("host_rules", F.array().cast("array<string>"))
    base = base_failed(F.col("rule_measures"), config)
    return joined.select(F.col("key").alias(key), "host", "rule_measures.*", base.alias("base_failed"), host_rules.alias("host_rules"), (~base & (F.size(host_rules) == 0)).alias("kept"))


def kept_documents(docs: DataFrame, config: HostConfig = HostConfig(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that neither they nor their hosts fail, with all their columns, whatever their names."""
    inside = measured(docs.select(F.struct("*").alias("row"), F.col(host).alias("host"), F.col(text).alias("text")), "text")
    failing = _failing(host_rates(inside.select("host", "rule_measures"), config), config)
    return inside.where(~base_failed(F.col("rule_measures"), config)).join(failing, "host", "left_anti").select("row.*")
