"""N-gram Jaccard join with PartEnum signatures.

Sets of shingles are put into size bands so that similar sets meet in one, where they differ in at
most k shingles. The shingle domain is split into n1 groups of n2 partitions; a signature is the
content of n2 - 1 partitions of a group, and every such subset is enumerated. A group in which two
sets agree gives them n2 signatures in common, one with differences in one partition gives one, any
other none: so similar sets share at least 2 * n1 - k signatures, always, and a set that shares fewer
with all others together is linked with nothing.

Sets that share a signature are compared with the smallest and the largest of them, and linked: first
by their sizes and by bitmaps of the shingles' parities, which differ in no more bits than the sets
do in shingles, then exactly. Where a signature's sets still lie in different components, their sets
are joined once more by their rarest shingles, under the same tests: two similar sets have one of
those in common, at places that leave room for enough others. So a large group of near copies is not
compared pair by pair, and no link that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, materialize
from .components import components


@dataclass(frozen=True)
class JoinConfig:
    words: int = 3
    #: Linked when den * |A and B| >= num * |A or B|.
    num: int = 90
    den: int = 100
    #: Bound of a worker's memory of word hashes; it is emptied when full.
    cached_words: int = 100_000


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


_HASHES = _Hashes()


def shingles(text: bytes | None, config: JoinConfig) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; a text of fewer words, but some, is one shingle."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    _HASHES.most = config.cached_words
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(config.words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mix(out * _M1 + h[k : len(h) - n + 1 + k])
    return np.unique(out)


class Bands:
    """Size bands, as wide as the similarity allows twice over, and the parameters of each.

    A set stands in its own band, and in the one below if a similar set may be there; so two similar
    sets meet in the smaller one's band.
    """

    def __init__(self, config: JoinConfig):
        self.config = config
        #: Sets smaller than this are similar to equal sets only.
        self.least = -(-config.num // (config.den - config.num))
        self.low, self.high = [self.least], [self._reach(self._reach(self.least))]

    def _reach(self, size: int) -> int:
        """The largest set that may be similar to one of that size."""
        return size * self.config.den // self.config.num

    def band(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(self._reach(self._reach(self.low[-1])))
        return int(np.searchsorted(self.high, size))

    def of(self, size: int) -> list[int]:
        """The bands in which a set of that size stands."""
        own = self.band(size)
        return [own - 1, own] if own and size <= self._reach(self.high[own - 1]) else [own]

    def shape(self, i: int) -> tuple[int, int, int]:
        """(n1, n2, need) of a band: similar sets in it share ``need`` signatures or more.

        Similar sets of sizes a and b, one in the band, differ in (den - num) / (den + num) * (a + b)
        shingles at most. At most k // 2 groups have two differences; there are more groups than
        that, so that a set needs many shared signatures. Small sets get fewer and larger subsets, so
        that a signature always holds many shingles.
        """
        c, top = self.config, self.high[i]
        k = (c.den - c.num) * (top + self._reach(top)) // (c.den + c.num)
        n1 = k // 2 + 1 + (0 if k <= 6 else 1 + k // 8)
        return n1, 5 if k <= 6 else 3 if k <= 16 else 2, 2 * n1 - k


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, ...]:
    """Signatures of many sets at once, and for each the number of its stand; then for each stand (a
    set in one of its bands) the index of the set, the band, and how many shared signatures it needs.

    Empty subsets are left out where the set has so few that similar sets share others besides, and
    then the set needs as many less.
    """
    sigs, stands, tables, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((3, 0), np.int64)], 0
    work: dict[int, list[tuple[int, int, int, int]]] = {}
    for i, s in enumerate(sets):
        if len(s) >= bands.least:
            for k in bands.of(len(s)):
                n1, n2, need = bands.shape(k)
                work.setdefault(n2, []).append((i, k, n1, need))
    for n2, items in work.items():
        index, band, n1, need = (np.array(c) for c in zip(*items))
        sizes = np.array([len(sets[i]) for i in index])
        flat = np.concatenate([sets[i] for i in index])
        content = _mix(flat ^ np.uint64(0x5851F42D4C957F2D))
        starts = np.concatenate([[0], np.cumsum(n2 * n1)])
        part = np.repeat(starts[:-1], sizes) + (flat % np.repeat(n2 * n1, sizes).astype(np.uint64)).astype(np.int64)
        total = int(starts[-1])
        count = np.bincount(part, minlength=total).reshape(-1, n2)
        # Sums of 32-bit halves are exact in a double; together they are the sum modulo 2**64.
        low = np.bincount(part, weights=(content & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total).astype(np.uint64)
        high = np.bincount(part, weights=(content >> np.uint64(32)).astype(np.float64), minlength=total).astype(np.uint64)
        value = _mix((low + (high << np.uint64(32))).reshape(-1, n2) + np.arange(1, n2 + 1, dtype=np.uint64))
        owner = np.repeat(np.arange(len(index)), n1)
        group = np.arange(len(owner)) - np.repeat(np.cumsum(n1) - n1, n1)
        tag = _mix(((band + 2).astype(np.uint64)[owner] << np.uint64(32)) + group.astype(np.uint64))
        empty = count.sum(1)[:, None] == count
        blank = np.bincount(owner, weights=empty.sum(1), minlength=len(index)).astype(np.int64)
        few = blank < need
        give = ~(empty & few[owner][:, None])
        whole = value.sum(1, dtype=np.uint64)[:, None] - value
        sig = _mix(_mix(whole + tag[:, None]) + np.arange(n2, dtype=np.uint64))
        sigs.append(sig[give])
        stands.append(np.broadcast_to(owner[:, None], sig.shape)[give] + offset)
        tables.append(np.stack([index, band, np.where(few, need - blank, 1)]))
        offset += len(index)
    return np.concatenate(sigs), np.concatenate(stands), *np.concatenate(tables, axis=1)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch], config: JoinConfig) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column("text").to_pylist():
            s = shingles(t, config)
            rows.append((len(s), *(_digest(s) if len(s) else (None, None))))
        n, d, e = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.int64())], names=["doc_id", "k1", "k2", "n_shingles", "node", "check"])


#: Shingles that are turned into signatures at once.
AT_ONCE = 100_000


#: Bits of the filter of shared signatures, and of one of the segments that it is made in.
FILTER_BITS, SEGMENT_BITS = 1 << 27, 1 << 17


def _segment(rows: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT_BITS, dtype=bool)
    bits[rows.column("bit").to_numpy() % SEGMENT_BITS] = True
    return pa.table({"segment": rows.column("segment")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _filter(sigs: DataFrame) -> np.ndarray:
    """A bitmap of fixed size: a signature whose bit is not set is not among ``sigs``.

    However many there are, it has FILTER_BITS; when most are set it lets too much pass, and the
    join that follows decides.
    """
    bit = sigs.select(F.pmod("sig", F.lit(FILTER_BITS)).alias("bit")).distinct().withColumn("segment", F.floor(F.col("bit") / SEGMENT_BITS))
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in bit.groupBy("segment").applyInArrow(_segment, "segment bigint, bits binary").toLocalIterator():
        out[r["segment"] * SEGMENT_BITS // 8 :][: SEGMENT_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _passes(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (values % np.uint64(FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


class _Sent:
    """The smallest and the largest node that a task has sent for a signature, in a table of bounded size.

    What lies between them tells nothing new about a signature's ends, so copies, and the many sets
    that share a signature, are left out before they are shuffled.
    """

    def __init__(self, slots: int = 1 << 20):
        self.slots = np.uint64(slots)
        self.sig, self.lo, self.hi = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.int64)

    def new(self, sig: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Which rows are to be sent; they count as sent from now on."""
        at = (sig % self.slots).astype(np.int64)
        same = self.sig[at] == sig
        give = ~(same & (self.lo[at] <= node) & (node <= self.hi[at]))
        wider, other = give & same, give & ~same
        np.minimum.at(self.lo, at[wider], node[wider])
        np.maximum.at(self.hi, at[wider], node[wider])
        for table, values in ((self.sig, sig), (self.lo, node), (self.hi, node)):
            table[at[other]] = values[other]  # the last one of a slot, in all three
        return give


def _signed(batches: Iterator[pa.RecordBatch], config: JoinConfig, shared=None) -> Iterator[pa.RecordBatch]:
    """(sig, node, band, need) of every text, as far as it may be an end of its signature's nodes; with
    ``shared``, a broadcast filter, all signatures that it lets pass, of sets that have as many of them
    as they need in the band."""
    bands, sent = Bands(config), _Sent()

    def give(sets: list[np.ndarray]) -> pa.RecordBatch:
        sig, stand, owner, band, need = signatures(sets, bands)
        nodes = np.array([_digest(s)[0] for s in sets], dtype=np.int64)
        if shared is not None:
            passes = _passes(sig, shared.value)
            passes &= (np.bincount(stand[passes], minlength=len(need)) >= need)[stand]
        else:
            passes = sent.new(sig, nodes[owner[stand]])
        sig, stand = sig[passes], stand[passes]
        return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(nodes[owner[stand]]), pa.array(band[stand].astype(np.int32)), pa.array(need[stand].astype(np.int32))], names=["sig", "node", "band", "need"])

    for batch in batches:
        waiting, n = [], 0
        for t in batch.column(0).to_pylist():
            s = shingles(t, config)
            if len(s) >= bands.least:
                waiting.append(s)
                n += len(s)
            if n >= AT_ONCE:
                yield give(waiting)
                waiting, n = [], 0
        if waiting:
            yield give(waiting)


#: 64-bit words of a set's bitmap of parities.
BITMAP_WORDS = 16


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Bit i tells if the set has an odd number of shingles that are put there."""
    at = (_mix(s ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * BITMAP_WORDS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * BITMAP_WORDS) & 1).astype(bool)).view(np.int64)


def _arrays(batches: Iterator[pa.RecordBatch], config: JoinConfig, wanted) -> Iterator[pa.RecordBatch]:
    """(node, size, bits, shingles) of the texts whose first key ``wanted``, a broadcast filter, lets pass."""
    given: set[int] = set()  # copies within a task are sent once, as far as its bound goes
    for batch in batches:
        batch = batch.filter(pa.array(_passes(batch.column("k1").to_numpy().view(np.uint64), wanted.value)))
        for k in range(0, batch.num_rows, 256):
            sets: dict[int, np.ndarray] = {}
            for t in batch.column("text").slice(k, 256).to_pylist():
                s = shingles(t, config)
                if len(s) and (node := _digest(s)[0]) not in given:
                    sets[node] = s
            if len(given) > config.cached_words:
                given.clear()
            given.update(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sets), pa.int64()), pa.array([len(s) for s in sets.values()], pa.int64()), pa.array([_bitmap(s) for s in sets.values()], pa.list_(pa.int64())), pa.array([s.view(np.int64) for s in sets.values()], pa.list_(pa.int64()))],
                names=["node", "size", "bits", "shingles"],
            )


def _may_link(l: str, r: str, config: JoinConfig) -> Column:
    """False only for sets, under two aliases, that cannot be similar by their sizes and bitmaps."""
    a, b = F.col(f"{l}.size"), F.col(f"{r}.size")
    differ = reduce(add, (F.bit_count(F.col(f"{l}.bits")[i].bitwiseXOR(F.col(f"{r}.bits")[i])) for i in range(BITMAP_WORDS)))
    return (F.least(a, b) * config.den >= F.greatest(a, b) * config.num) & (differ * (config.den + config.num) <= (a + b) * (config.den - config.num))


def _linked(pairs: DataFrame, texts: DataFrame, config: JoinConfig) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar; ``texts``: (node, shingles) of every node in them."""
    x = texts.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(both * config.den >= (F.size("x") + F.size("y") - both) * config.num).select("a", "b")


def _rare_pairs(sets: DataFrame, config: JoinConfig) -> DataFrame:
    """Pairs (a < b) of nodes in different components that may be similar; ``sets``: node, component, shingles.

    In one order of all shingles, rarest first, similar sets have a shingle in common among the
    first size - least overlap + 1 of each. At the first one they have in common, what follows in
    either set must be enough for the overlap that the similarity asks for.
    """
    rows = sets.select("node", "component", "size", F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often")).where(F.col("often") > 1)
    # Shingles of one set only come first in any case: their number is what is missing.
    seen = rows.join(often, "shingle")
    ordered = seen.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))).withColumn("of", F.count("*").over(Window.partitionBy("node")))
    ordered = ordered.withColumn("at", F.col("k") + F.col("size") - F.col("of"))
    least = F.ceil(F.col("size") * config.num / config.den)
    first = ordered.where(F.col("at") <= F.col("size") - least + 1).select("shingle", "node", "component", "size", "at")
    first = materialize(first.join(sets.select("node", "bits"), "node"), "rarest")
    both = F.col("l.size") + F.col("r.size")
    overlap = F.least(F.col("l.size") - F.col("l.at"), F.col("r.size") - F.col("r.at")) + 1
    may = (F.col("l.node") < F.col("r.node")) & (F.col("l.component") != F.col("r.component")) & (overlap * (config.den + config.num) >= both * config.num)
    on = (F.col("l.shingle") == F.col("r.shingle")) & may & _may_link("l", "r", config)
    return first.alias("l").join(first.alias("r"), on).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def _keys() -> list[Column]:
    """Two 64-bit hashes of a text, by which tasks know it again without its shingles."""
    text = F.col("text").cast("binary")
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _components(docs: DataFrame, config: JoinConfig) -> tuple[DataFrame, DataFrame]:
    """doc_id, k1, k2, n_shingles, node of every row; and of every node its smallest id and its component, a node."""
    spark = docs.sparkSession
    text = F.col("text").cast("binary").alias("text")
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(), text).mapInArrow(lambda it: _sets(it, config), "doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, node bigint, check bigint")
    sets = materialize(made, "sets")
    # Equal sets are one node; its digest is checked against a second one.
    nodes = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.min("check").alias("c"), F.max("check").alias("d"))
    nodes = nodes.withColumn("first", F.when(F.col("c") == F.col("d"), F.col("first")).otherwise(F.raise_error(F.lit("two sets have one digest")).cast("long"))).select("node", "first")
    nodes = materialize(nodes, "nodes")
    kinds = "sig bigint, node bigint, band int, need int"
    signed = docs.select(text).mapInArrow(lambda it: _signed(it, config), kinds)
    # Already aggregated in the tasks: hash tables of nearly as many signatures as rows would save nothing.
    shared = signed.select("sig", "node").repartition("sig").groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where(F.col("lo") != F.col("hi")).select("sig")
    shared = materialize(shared, "shared-signatures")
    # Rows of equal sets are equal; only signatures that different sets share go on.
    passing = spark.sparkContext.broadcast(_filter(shared))
    signed = docs.select(text).mapInArrow(lambda it: _signed(it, config, passing), kinds)
    signed = materialize(signed.join(shared, "sig", "left_semi").distinct(), "signed")
    enough = signed.groupBy("node", "band").agg(F.count("*").alias("n"), F.max("need").alias("need")).where(F.col("n") >= F.col("need")).select("node", "band")
    placed = materialize(signed.join(enough, ["node", "band"], "left_semi").select("sig", "node"), "placed")
    ends = placed.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where(F.col("lo") != F.col("hi"))
    shared = materialize(placed.join(ends, "sig"), "shared")
    found = materialize(shared.select("node").distinct(), "found")
    # A set's node is its digest, made where the set is made, so no id decides whose set it is.
    wanted = spark.sparkContext.broadcast(_filter(sets.join(found, "node", "left_semi").select(F.col("k1").alias("sig"))))
    made = docs.select(F.xxhash64(text).alias("k1"), text).mapInArrow(lambda it: _arrays(it, config, wanted), "node bigint, size bigint, bits array<bigint>, shingles array<bigint>")
    arrays = materialize(made.join(found, "node", "left_semi").dropDuplicates(["node"]), "arrays")
    marks = arrays.select("node", "size", "bits")
    pairs = shared.select(F.col("lo").alias("a"), F.col("node").alias("b")).unionByName(shared.select(F.col("node").alias("a"), F.col("hi").alias("b")))
    tried = materialize(pairs.where(F.col("a") != F.col("b")).distinct(), "tried")
    first = tried.join(marks.withColumnRenamed("node", "a"), "a").alias("l")
    near = materialize(first.join(marks.alias("r"), (F.col("l.b") == F.col("r.node")) & _may_link("l", "r", config)).select("a", "b"), "near")
    links = materialize(_linked(near, arrays, config), "links")
    comp = materialize(components(links), "components")
    placed = shared.select("sig", "node").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(F.col("x") != F.col("y")).select("sig")
    open_nodes = materialize(placed.join(several, "sig").select("node", "component").distinct(), "open")
    more = materialize(_rare_pairs(arrays.join(open_nodes, "node"), config).join(tried, ["a", "b"], "left_anti"), "near")
    more = materialize(_linked(more, arrays, config), "links")
    if not more.isEmpty():
        comp = materialize(components(links.unionByName(more)), "components")
    names = nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return sets, names


def similar(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach, the row's own included. Null and empty
    texts and texts of white space have no shingles, link with nothing and keep their own id. Rows
    with equal texts are linked; different texts under one id only if they are similar. A row whose
    id is null has component null unless it is linked to a row with an id. Other columns are ignored.
    """
    sets, names = _components(docs, config)
    least = names.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(names.join(least, "component").select("node", "component_id"), "named")
    rows = sets.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """One row of ``docs`` of each component, one with the smallest id, as it came; null ids come last.

    Of rows with that id, the one whose text has the smallest hash stays; of rows with one id and one
    text, the first by all its columns. Rows without shingles link with nothing and all stay.
    """
    sets, names = _components(docs, config)
    key = ["none", "id", "k1", "k2"]
    own = F.col("doc_id").cast("long")
    id_key = [own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id")]
    rows = sets.join(names.select("node", "component"), "node").select("component", *id_key, "k1", "k2")
    counted = rows.groupBy("component", *key).agg(F.count("*").alias("of"))
    first = counted.groupBy("component").agg(F.min(F.struct(*key, "of")).alias("r")).select("r.*")
    words = F.coalesce(F.col("text").cast("string").rlike(SPACED_WORD), F.lit(False))
    whole = docs.select(F.struct(*docs.columns).alias("row"), *id_key, *_keys(), words.alias("words"))
    # Rows without words get a key that no other row has, so they are spread and none goes.
    whole = whole.withColumn("k1", F.when(F.col("words"), F.col("k1")).otherwise(F.monotonically_increasing_id())).withColumn("k2", F.when(F.col("words"), F.col("k2")))
    kept = whole.join(first, key, "left").where(~F.col("words") | F.col("of").isNotNull())
    order = F.when(F.col("of") > 1, F.to_json("row")).otherwise("")
    alike = kept.groupBy(*key, "words").agg(F.min_by("row", order).alias("row"))
    return alike.select("row.*")
