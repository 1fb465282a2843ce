"""Scoring texts with a language model: counts of the whole corpus and a self-attention model.

A text's tokens are its words, A-Z lower-cased, and one end. The attention model (see ``attention``)
predicts from the subwords before a word the class of the word's first subword. A word of the corpus
then has its share, by its count, of the words whose first subword is of that class; a new word is
spelled in subwords that the attention model predicts, each from those before it. What new words
get in all is estimated by the words that the corpus has once (Good and Turing).

The counts are gathered block by block: texts are dealt into blocks of bounded size, each block
sends its distinct words once, a word's counts are summed over the blocks, it is spelled, and both go
back to the blocks that hold it, by the word's place among the block's words. So texts become subwords
once, for learning and for scoring. No task or driver holds the corpus's vocabulary.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .attention import AttentionConfig, Classes, Model, classes_of, frequent, score_streams
from .common import bucket_of, materialize

#: The end as a word: no word holds white space.
END = "\n"


@dataclass(frozen=True)
class ScoreConfig:
    attention: AttentionConfig = AttentionConfig()
    #: Bound of the sample that the attention model starts from: texts with the smallest hash of
    #: their id, whole, until so many subwords. After that every block learns on from all its training
    #: texts, which also tell the classes and the counts.
    sample_texts: int = 1000
    sample_subwords: int = 600_000
    #: Text bytes of a block.
    block_bytes: int = 8_000_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # bytes: A-Z and ASCII white space only


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, the place among them of each word of each text, and the texts' numbers of words.

    The last distinct word is the end, and the last word of each text.
    """
    texts = texts.take(pa.array(np.arange(len(texts))))  # a copy: Arrow's splitting takes wrong bytes of a slice
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").cast(pa.large_string())))
    stops = lists.offsets.to_numpy()
    lists = lists.flatten().dictionary_encode()
    words, at = lists.dictionary.cast(pa.large_binary()), lists.indices.to_numpy()
    none = pc.index(words, pa.scalar(b"", pa.large_binary())).as_py()  # beside white space at either end of a text
    real = at != none
    kept = np.concatenate([[0], np.cumsum(real)])[stops - stops[0]]
    n = np.diff(kept) + 1
    codes = np.full(int(n.sum()), len(words), np.int32)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(n) - 1] = False
    codes[inside] = at[real]
    words = pa.concat_arrays([words, pa.array([END.encode()], pa.large_binary())])
    if none >= 0:
        words = pa.concat_arrays([words[:none], words[none + 1 :]])
        codes -= codes > none
    return words, codes, n


def _ranks(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words, and the place of each in it."""
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return order, rank


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, k, word, n): how often training texts of the block have the word (0: only others do), k: its place among the block's words."""
    now, parts = None, []

    def merged() -> pa.Table:
        both = pa.concat_tables(parts)
        return both.group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]) if len(parts) > 1 else both

    def give() -> pa.RecordBatch:
        found = merged().combine_chunks()
        words = found.column("word").chunk(0)
        order, _ = _ranks(words)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(order), now, np.int64)), pa.array(np.arange(len(order), dtype=np.int32)), words.take(pa.array(order)).cast(pa.string()), found.column("n").chunk(0).take(pa.array(order))], names=["block", "k", "word", "n"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.diff(blocks, prepend=-1))
        for first, stop in zip(starts, [*starts[1:], len(blocks)]):
            if blocks[first] != now:
                if parts:
                    yield give()
                now, parts = int(blocks[first]), []
            words, codes, n = _coded(batch.column(1)[first:stop])
            trained = np.repeat(~batch.column(2)[first:stop].to_numpy(zero_copy_only=False), n)
            parts.append(pa.table({"word": words, "n": pa.array(np.bincount(codes[trained], minlength=len(words)))}))
            if len(parts) > 8:
                parts = [merged()]
    if parts:
        yield give()


_LOADED: dict[str, object] = {}


def _subwords(path: str):
    if path not in _LOADED:
        import sentencepiece

        _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LOADED[path]


def _spell(model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all words laid end to end, and each word's number of them; the end is one.

    A worker keeps the spellings of words that it has met, up to a bound.
    """
    known = _SPELLED.setdefault(id(model), {})
    new = [w for w in dict.fromkeys(words) if w not in known]
    if len(known) + len(new) > MOST_SPELLED:
        known.clear()
        new = list(dict.fromkeys(words))
    for k in range(0, len(new), 10_000):
        some = new[k : k + 10_000]
        for w, ids in zip(some, model.encode(some, num_threads=1)):
            known[w] = array("i", ids or [model.unk_id()]).tobytes()
    known[END] = array("i", [model.get_piece_size()]).tobytes()
    spelled = [known[w] for w in words]
    return np.frombuffer(b"".join(spelled), np.int32).astype(np.int64), np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4


_SPELLED: dict[int, dict[str, bytes]] = {}
#: Spellings that a worker keeps, about 150 bytes each.
MOST_SPELLED = 400_000


def _previous(classes: np.ndarray, sizes: np.ndarray, none: int) -> np.ndarray:
    """Class of the subword before each one in its word; ``none`` for a word's first."""
    before = np.concatenate([[none], classes[:-1]])
    before[np.cumsum(sizes) - sizes] = none
    return before


def _stream(texts: list[bytes | None], subwords) -> np.ndarray:
    """Subword ids of the texts end to end, each after an end; the last one is an end too."""
    number: dict[bytes, int] = {END.encode(): 0}
    at = np.fromiter((number.setdefault(w, len(number)) for t in [None, *texts] for w in [*words_of(t), END.encode()]), np.int64)
    ids, sizes = _spell(subwords, [w.decode() for w in number])
    first, each = (np.cumsum(sizes) - sizes)[at], sizes[at]
    begin = np.cumsum(each) - each
    return ids[np.repeat(first - begin, each) + np.arange(int(each.sum()))]


def _spellings(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    subwords = _subwords(path)
    for batch in batches:
        ids, sizes = _spell(subwords, batch.column(0).to_pylist())
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([lists, batch.column(1)], names=["ids", "c"])


def _ids_of(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subword ids of a batch of spellings (lists, or bytes as for ``_spelled_words``) end to end, their numbers, and the words' counts."""
    lists = batch.column(0)
    if pa.types.is_list(lists.type):
        ids, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    else:
        ids, sizes = _bytes_of(lists, _id_type(size))
    return ids.astype(np.int64), sizes.astype(np.int64), batch.column(1).to_numpy()


def _bytes_of(rows: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are kept as bytes, of all rows end to end, and how many each row has."""
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1] // np.dtype(kind).itemsize
    data = rows.buffers()[2]
    return (np.frombuffer(data, kind, offsets[-1])[offsets[0] :] if data is not None and offsets[-1] else np.zeros(0, kind)), np.diff(offsets)


def _as_bytes(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """``ids`` as one row of bytes for each of ``sizes``."""
    stops = (np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(ids))])


def _spelled_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(block, k, c, first, ids) of rows with a word; equal words stand side by side and are spelled once."""
    subwords = _subwords(path)
    size = subwords.get_piece_size()
    for batch in batches:
        words = batch.column(0).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        spelled = [[size] if w == END else ids or [subwords.unk_id()] for w, ids in zip(distinct, subwords.encode(distinct, num_threads=1))]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        rows = _as_bytes(np.fromiter(chain.from_iterable(spelled), _id_type(size), int(sizes.sum())), sizes)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], rows.take(words.indices)], names=["block", "k", "c", "first", "ids"])


def _subword_counts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    table = np.zeros(size + 1)
    for batch in batches:
        ids, sizes, counts = _ids_of(batch, size)
        table += np.bincount(ids, weights=np.repeat(counts, sizes), minlength=len(table))
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].astype(np.int64))], names=["id", "n"])


#: Text bytes that are spelled at once, and counts of neighbours that a task holds before it sends them.
AT_ONCE, MOST_CELLS = 2_000_000, 2_000_000


def _id_type(size: int) -> type:
    """The type in which ids up to ``size`` are kept, with a bit to spare."""
    return np.uint16 if size < 1 << 15 else np.int32


def _begins(size: int) -> int:
    """The bit that marks the first subword of a word, beside ids up to ``size``."""
    return 1 << 15 if size < 1 << 15 else 1 << 30


def _streams(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(block, ids): subword ids of each text, and an end."""
    subwords = _subwords(path)
    size = subwords.get_piece_size()
    kind = np.dtype(_id_type(size))

    for batch in batches:
        some, n, first = [], 0, 0
        texts = batch.column(1)
        for k in range(len(texts)):
            some.append(texts[k].as_py())
            n += len(some[-1] or b"")
            if n >= AT_ONCE or k == len(texts) - 1:
                stream = _stream(some, subwords)[1:].astype(kind)
                stops = (np.flatnonzero(stream == size) + 1) * kind.itemsize
                ids = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.concatenate([[0], stops]).astype(np.int32)), pa.py_buffer(stream)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : k + 1], ids], names=["block", "ids"])
                some, n, first = [], 0, k + 1


def _joined(rows: list[bytes], size: int) -> np.ndarray:
    """Streams of texts end to end, after an end, without marks of words' first subwords."""
    return np.concatenate([[size], np.frombuffer(b"".join(rows), _id_type(size)) & (_begins(size) - 1)]).astype(np.int32)


def _neighbours(batches: Iterator[pa.RecordBatch], number: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, before, n): how often a frequent subword, or any other, stands before each subword."""
    cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cells // len(number)), pa.array(cells % len(number)), pa.array(counts)], names=["id", "before", "n"])

    for batch in batches:
        some, n = [], 0
        streams = batch.column(0)
        for k in range(len(streams)):
            some.append(streams[k].as_py())
            n += len(some[-1])
            if n >= AT_ONCE or k == len(streams) - 1:
                stream = _joined(some, len(number) - 1)
                found, often = np.unique(stream[1:].astype(np.int64) * len(number) + number[stream[:-1]], return_counts=True)
                cells, place = np.unique(np.concatenate([cells, found]), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([counts, often]), minlength=len(cells)).astype(np.int64)
                some, n = [], 0
                if len(cells) > MOST_CELLS:
                    yield give()
                    cells, counts = cells[:0], counts[:0]
    yield give()


def corpus_classes(streams: DataFrame, spelled: DataFrame, path: str, config: AttentionConfig) -> tuple[Classes, np.ndarray]:
    """Classes from the counts and the neighbours in all training texts, and the subwords beyond the
    frequent ones that have a class by their neighbours.

    ``streams``: ids, the training rows' subwords; ``spelled``: ids and c, each training word's subwords and count. What
    comes to the driver is bounded by the subwords; those beyond the frequent ones are put into classes in tasks.
    """
    spark = streams.sparkSession
    subwords = _subwords(path)
    size = subwords.get_piece_size()
    counts = np.zeros(size + 1)
    for r in spelled.mapInArrow(lambda it: _subword_counts(it, size), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]
    seen = frequent(counts, size)
    number = np.full(size + 1, len(seen), dtype=np.int64)
    number[seen] = np.arange(len(seen))
    known = spark.sparkContext.broadcast(number)
    pairs = streams.select("ids").mapInArrow(lambda it: _neighbours(it, known.value), "id bigint, before bigint, n bigint").groupBy("id", "before").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs, "neighbours")
    is_seen = F.col("id").isin(seen.tolist())
    table = np.zeros((len(seen), len(seen) + 1))
    got = pairs.where(is_seen).toArrow()  # at most frequent x frequent cells
    table[number[got.column("id").to_numpy()], got.column("before").to_numpy()] = got.column("n").to_numpy()
    starts = np.array([subwords.id_to_piece(i).startswith("▁") for i in range(size)] + [True])
    classes, space = classes_of(counts, table, starts, size, config)
    others = np.setdiff1d(np.flatnonzero(counts[:size] >= 5), seen)
    others = others[[bool(starts[i]) in space.centres for i in others]] if len(others) else others
    shared = spark.sparkContext.broadcast((space, starts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, start = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = np.zeros(len(ids), np.int64)
            for k, (i, before, n) in enumerate(zip(ids, batch.column(1), batch.column(2))):
                row = np.zeros((1, len(made.total)))
                row[0, before.values.to_numpy()] = n.values.to_numpy()
                at[k] = made.near(made.points(row), bool(start[i]))[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], names=["id", "class"])

    wanted = spark.createDataFrame([(int(i),) for i in others], "id bigint")
    listed = pairs.join(F.broadcast(wanted), "id", "left_semi").groupBy("id").agg(F.collect_list(F.struct("before", "n")).alias("p"))  # at most a row of the table each
    for r in listed.select("id", "p.before", "p.n").mapInArrow(place, "id bigint, class bigint").toLocalIterator():
        classes.of[r["id"]] = r["class"]
    classes.row[others] = len(seen) + classes.of[others]
    return classes, others


def train_attention(dealt: DataFrame, spelled: DataFrame, path: str, config: ScoreConfig, streams: DataFrame | None = None) -> Model:
    """The model; ``dealt``: doc_id, text, block of training rows, ``spelled``: ids, c of training words,
    ``streams``: block, ids of all training rows where they are spelled already.

    It starts from a bounded sample. Then every block learns on from there over all its texts, and
    the blocks' weights are averaged: by subwords learned from, an embedding by its own number.
    """
    # Chosen by hash without their texts; the bounded list of hashes is broadcast to fetch those.
    rows = dealt.select("doc_id", "text")
    key = F.xxhash64("doc_id").alias("h")
    chosen = rows.select(key).distinct().orderBy("h").limit(config.sample_texts)
    found = materialize(rows.select(key, "text").join(F.broadcast(chosen), "h"), "sample")
    sample = found.orderBy("h", "text").toLocalIterator()
    subwords = _subwords(path)
    stream, n = [], 0
    for r in sample:
        if n >= config.sample_subwords:
            break
        stream.append(_stream([r["text"]], subwords)[1:])
        n += len(stream[-1])
    if streams is None:
        streams = materialize(dealt.select("block", "text").mapInArrow(lambda it: _streams(it, path), "block bigint, ids binary"), "streams")  # spelled once, read twice
    classes, others = corpus_classes(streams, spelled, path, config.attention)
    model = Model(config.attention, classes)
    if not stream:
        model.init()
        return model
    model.train(np.concatenate(stream))
    if not model.w:
        model.init()
    model.own_rows(others)
    shared = dealt.sparkSession.sparkContext.broadcast(model)
    names = sorted(k for k in model.w if k != "E")

    def learn(rows: pa.Table) -> pa.Table:
        start: Model = shared.value
        own = Model(start.config, start.classes, {k: v.copy() for k, v in start.w.items()})
        stream = _joined(sorted(rows.column("ids").to_pylist()), start.classes.end)
        count = own.tune(stream).astype(np.float64)
        parts = [count, (own.w["E"] * count[:, None]).reshape(-1), [count.sum()], *(own.w[k].reshape(-1) * count.sum() for k in names)]
        return pa.table({"sums": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

    learned = streams.groupBy("block").applyInArrow(learn, "sums binary")
    sums = learned.rdd.map(lambda r: np.frombuffer(r["sums"])).treeAggregate(np.zeros(1), np.add, np.add)
    e = model.w["E"]
    if len(sums) == 1 or not sums[len(e) + e.size]:  # no subword stands before another
        return model
    count, of_e, rest = np.split(sums, [len(e), len(e) + e.size])
    model.w["E"] = np.where(count[:, None] > 0, of_e.reshape(e.shape) / np.maximum(count, 1)[:, None], e).astype(np.float32)
    at = 1
    for k in names:
        v = model.w[k]
        model.w[k] = (rest[at : at + v.size] / rest[0]).reshape(v.shape).astype(np.float32)
        at += v.size
    return model


def _class_counts(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    classes = model.value.classes
    width = len(classes.of)
    table = np.zeros((classes.count + 1) * width)
    for batch in batches:
        ids, sizes, counts = _ids_of(batch, classes.end)
        weight = np.repeat(counts, sizes)
        before = _previous(classes.of[ids], sizes, classes.count)
        table += np.bincount(before * width + ids, weights=weight, minlength=len(table))
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].astype(np.int64))], names=["cell", "n"])


def within_class(counts: np.ndarray, model: Model) -> np.ndarray:
    """Log probability of a subword within its class, by the class before it; rows: class before.

    Smoothed by the class's own counts, and those by one for each subword, so all are positive and
    each class's subwords sum to 1.
    """
    classes = model.classes
    plain = counts.sum(0) + 1.0
    of_class = np.bincount(classes.of, weights=plain, minlength=classes.count)
    plain = plain / of_class[classes.of]
    sums = np.stack([np.bincount(classes.of, weights=row, minlength=classes.count) for row in counts])
    strength = 20.0
    return np.log((counts + strength * plain[None]) / (sums[:, classes.of] + strength)).astype(np.float32)


@dataclass
class Scorer:
    model: Model
    table: np.ndarray
    tokens: int
    distinct: int
    #: Share of tokens that are new words, estimated by those that the corpus has once.
    new_share: float
    #: Log of the words' count by the class of their first subword.
    of_class: np.ndarray

    @cached_property
    def places(self) -> np.ndarray:
        return self.model.places()

    def score(self, marked: np.ndarray, sizes: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Natural log probabilities of texts, without the logs of their known words' counts.

        ``marked``: subword ids of the texts end to end, marked where a word begins; ``sizes``: each text's number of
        them; ``new``: where new words begin.
        """
        classes = self.model.classes
        mark = _begins(classes.end)
        ids = (marked & (mark - 1)).astype(np.int64)
        begin = np.flatnonzero(marked & mark)
        text_at = np.cumsum(sizes) - sizes
        # A known word is told by its first subword, a new one by all.
        asked = np.zeros(len(ids), bool)
        asked[begin] = True
        word = np.searchsorted(begin, new)
        each = np.append(begin, len(ids))[word + 1] - new
        first = np.cumsum(each) - each
        place = np.repeat(new - first, each) + np.arange(int(each.sum()))
        asked[place] = True
        within, kind = score_streams(self.model, ids, text_at, asked, self.places)
        known = np.delete(begin, word)
        value = np.zeros(len(ids))
        value[known] = within[known] - self.of_class[classes.of[ids[known]]] + np.log(1 - self.new_share)
        if len(new):
            inside = self.table[_previous(classes.of[ids[place]], each, classes.count), ids[place]]
            spelled = np.add.reduceat(within[place].astype(np.float64) + kind[place] + inside, first) - kind[new] + np.log(self.new_share)
            # A spelled word ends where the next begins; the end of the text ends by itself.
            value[new] = spelled + np.where(ids[new] == classes.end, 0.0, np.append(kind, 0.0)[new + each])
        return np.add.reduceat(value, text_at)


def _encoded(left: pa.Table, right: pa.Table, path: str) -> pa.Table:
    """A block's rows as marked subword ids, with the numbers of their words; ``right``: k, c, ids of the block's words."""
    size = _subwords(path).get_piece_size()
    kind = _id_type(size)
    texts = left.column("text").combine_chunks()
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    words, codes, n = _coded(texts)
    right = right.combine_chunks().sort_by("k")
    if right.num_rows != len(words):
        raise ValueError("a block's words are not those that it sent")
    counts = right.column("c").to_numpy()
    flat, lengths = _bytes_of(pa.concat_arrays(right.column("ids").chunks), kind)
    at = _ranks(words)[1][codes]
    marked = flat.copy()
    start = np.cumsum(lengths) - lengths
    marked[start] |= np.array(_begins(size), kind)
    each = lengths[at]
    begin = np.cumsum(each) - each
    ids = marked[np.repeat(start[at] - begin, each) + np.arange(int(each.sum()))]
    word_at = np.cumsum(n) - n
    sizes = np.add.reduceat(each, word_at)
    text_at = np.cumsum(sizes) - sizes
    c = counts[at]
    unknown = np.flatnonzero(c == 0)
    text_of = np.repeat(np.arange(len(n)), n)[unknown]
    sums = lambda v: np.add.reduceat(v[at], word_at)
    return pa.table({
        "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "block": left.column("block"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(sums((counts > 0).astype(np.int64))),
        "log_more": pa.array(sums(np.log10(counts + 1.0))), "log_known": pa.array(sums(np.log(np.maximum(counts, 1)))),
        "ids": _as_bytes(ids, sizes), "new": _as_bytes((begin[unknown] - text_at[text_of]).astype(np.int32), np.bincount(text_of, minlength=len(n))),
    })


#: Subwords that are scored at once.
SCORED_AT_ONCE = 200_000


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    scorer: Scorer = shared.value
    kind = _id_type(scorer.model.classes.end)
    for batch in batches:
        ids, new = (batch.column(k).to_pylist() for k in (5, 6))
        place: dict[tuple[bytes, bytes], int] = {}
        which = [place.setdefault(x, len(place)) for x in zip(ids, new)]  # equal texts are scored once
        logs, some, n = [], [], 0
        for k, (i, w) in enumerate(place):
            some.append((np.frombuffer(i, kind), np.frombuffer(w, np.int32)))
            n += len(some[-1][0])
            if n >= SCORED_AT_ONCE or k == len(place) - 1:
                sizes = np.array([len(i) for i, _ in some])
                begin = np.cumsum(sizes) - sizes
                logs.append(scorer.score(np.concatenate([i for i, _ in some]), sizes, np.concatenate([w + b for (_, w), b in zip(some, begin)])))
                some, n = [], 0
        score = (np.concatenate(logs)[which] if logs else np.zeros(0)) + batch.column(8).to_numpy()
        tokens = batch.column(2).to_numpy()
        base = batch.column(7).to_numpy() - tokens * np.log10(scorer.tokens + scorer.distinct + 1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(len(tokens), scorer.tokens, np.int64)), pa.array(base), pa.array(score / np.log(10))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def spell(once: DataFrame, path: str) -> DataFrame:
    """(ids, c) of each row (word, c): the word's subwords."""
    return once.select("word", "c").mapInArrow(lambda it: _spellings(it, path), "ids array<int>, c bigint")


def held_out(doc_id: Column) -> Column:
    return bucket_of(doc_id, 7) == 2


def score(docs: DataFrame, path: str, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id as text) mod 7 is 2 are held out; all others are learned from. Null and
    empty texts are the end alone. Repeated rows each count and are each scored; without training
    rows nothing is known. Other columns are ignored.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // config.block_bytes))
    given = given.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    dealt = given.repartition(blocks, "block")
    pairs = dealt.sortWithinPartitions("block").select("block", "text", "held_out").mapInArrow(_block_words, "block bigint, k int, word string, n bigint")
    of_word = Window.partitionBy("word")  # one row per block and word
    counted = pairs.select("word", "block", "k", F.sum("n").over(of_word).alias("c"), (F.min("block").over(of_word) == F.col("block")).alias("first"))
    counted = materialize(counted.mapInArrow(lambda it: _spelled_words(it, path), "block bigint, k int, c bigint, first boolean, ids binary"), "word-counts")
    once = counted.where(F.col("first") & (F.col("c") > 0))
    sums = once.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    spelled = once.select("ids", "c")
    schema = "doc_id bigint, held_out boolean, block bigint, n_tokens bigint, n_known bigint, log_more double, log_known double, ids binary, new binary"
    encoded = dealt.groupBy("block").cogroup(counted.select("block", "k", "c", "ids").groupBy("block")).applyInArrow(lambda left, right: _encoded(left, right, path), schema)
    encoded = materialize(encoded, "encoded")
    training = ~F.col("held_out")
    model = train_attention(given.where(training), spelled, path, config, encoded.where(training).select("block", "ids"))
    shared = spark.sparkContext.broadcast(model)
    cells = spelled.mapInArrow(lambda it: _class_counts(it, shared), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros((model.classes.count + 1, len(model.classes.of)))
    for r in cells.toLocalIterator():  # at most classes x subwords of the model, whatever the corpus
        table.flat[r["cell"]] = r["n"]
    first = np.bincount(model.classes.of, weights=table[-1], minlength=model.classes.count)  # words by their first subword
    new_share = (sums["once"] + 1) / (sums["n"] + 2)
    scorer = spark.sparkContext.broadcast(Scorer(model, within_class(table, model), int(sums["n"]), int(sums["v"]), new_share, np.log(np.maximum(first, 1))))
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return encoded.select("doc_id", "held_out", "n_tokens", "n_known", "block", "ids", "new", "log_more", "log_known").mapInArrow(lambda it: _scored(it, scorer), schema)
