"""Removal of repeated byte strings by a run-length index of the corpus, built in shards.

A byte is removed when a string of ``length`` bytes covers it that also begins earlier: in a document with a smaller id,
or earlier in the same document. Three steps, each a shuffle by content:

1. Parsing. Every string of ``length`` bytes names its trigger, the run of ``trigger`` bytes in it with the smallest hash.
   Neighbouring strings with one trigger form a phrase, so a text becomes overlapping phrases of less than
   ``2 * length`` bytes that depend on content alone, and equal strings lie in phrases with equal triggers. (This is the
   prefix-free parsing by which run-length transforms of repetitive texts are built: copies of a phrase are indexed once.)
2. Dictionary. Phrases meet by trigger. Of equal phrases (64-bit fingerprints under equal triggers) the first stays,
   the others are repeats. A trigger with one phrase left has nothing more to tell.
3. Index. The texts of the phrases that share a trigger are gathered in shards, in the order of their documents. Each
   shard is indexed by a run-length transform with sampled run ends (``run_index``), its matching statistics are
   streamed, and matches of ``length`` bytes and more lead to the earliest place of a string.

Hot keys: copies of a phrase are combined within a batch before the shuffle, so a passage in a third of all documents
costs one row per batch. A trigger with very many different phrases (the edge of such a passage: another context in
every document) is parsed into single strings instead, which are all of the dictionary's work and spread evenly;
triggers are told to be hot by counts over all rows. Nothing is dropped, and no step holds more than one shard or batch.

Defined results: null text counts as empty; a text shorter than ``length`` keeps all its bytes; null ids come first;
rows with equal id and equal text are one document and get the same result; rows with an equal id and different texts
follow each other by a hash of the text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import text_slices, utf8
from docquarry.llm.run_index import SEPARATOR, RunIndex
from docquarry.session import broadcast_if_small, materialise

BLOCK_BYTES = 1 << 18
BATCH_PHRASES = 1 << 19
NULL_ID = -(1 << 63)
HOT_LIST = 1_000_000


@dataclass(frozen=True)
class RepeatRule:
    """``trigger`` is at least eight bytes and shorter than ``length``.

    A shard of the dictionary holds the phrases of about ``shard_bytes`` of text, one of the index ``index_bytes`` of
    phrases. Triggers with more than ``hot_phrases`` different phrases (or one in a million of all phrases, if that
    is more) are parsed into strings, and so are those with more than ``index_phrases`` when they come to the index.
    """

    length: int = 100
    trigger: int = 32
    shard_bytes: int = 16 << 20
    index_bytes: int = 1 << 20
    hot_phrases: int = 50_000
    index_phrases: int = 4_000

    def __post_init__(self) -> None:
        if not 8 <= self.trigger < self.length:
            raise ValueError("a trigger has eight bytes at least and fewer than the strings")


@dataclass(frozen=True)
class Phrases:
    """Columns of phrases: trigger and fingerprint, document (id, hash of the text), place and size in bytes."""

    trigger: np.ndarray
    mark: np.ndarray
    doc: np.ndarray
    text: np.ndarray
    start: np.ndarray
    size: np.ndarray

    KINDS = ("<u8", "<u8", "<i8", "<i8", "<i8", "<i4")

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.trigger, self.mark, self.doc, self.text, self.start, self.size

    def take(self, rows: np.ndarray) -> Phrases:
        return Phrases(*(c[rows] for c in self.columns()))

    def pack(self) -> bytes:
        return b"".join(c.astype(kind).tobytes() for c, kind in zip(self.columns(), self.KINDS))

    @staticmethod
    def joined(parts: list[Phrases]) -> Phrases:
        return Phrases(*(np.concatenate(c) for c in zip(*(p.columns() for p in parts))))

    @staticmethod
    def unpack(blobs: list[bytes]) -> Phrases:
        width = sum(np.dtype(k).itemsize for k in Phrases.KINDS)
        columns, at = [], [0] * len(blobs)
        for kind in Phrases.KINDS:
            parts = []
            for i, blob in enumerate(blobs):
                n = len(blob) // width
                parts.append(np.frombuffer(blob, kind, n, at[i]))
                at[i] += n * np.dtype(kind).itemsize
            columns.append(np.concatenate(parts) if parts else np.zeros(0, kind))
        return Phrases(*columns)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit integers."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C55


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2^64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    return both[0], both[1]


class _Hashes:
    """Hashes of all substrings (eight bytes and more) of a buffer, by sums of scrambled words times powers."""

    def __init__(self, buffer: bytes):
        words = np.ndarray((len(buffer) - 7,), "<u8", buffer=buffer, strides=(1,))
        powers, self.inverse = _powers(1 << max(20, len(buffer).bit_length()))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(_mixed(words) * powers[: len(words)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end - 7] - self.sums[begin]) * self.inverse[begin]
        return _mixed(raw + (end - begin).astype(np.uint64))

    def fixed(self, width: int) -> np.ndarray:
        """The hashes of all substrings of one width."""
        count = len(self.sums) + 7 - width
        raw = (self.sums[width - 7 :][:count] - self.sums[:count]) * self.inverse[:count]
        return _mixed(raw + np.uint64(width))


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about BLOCK_BYTES: (bytes, row and place of each piece in its text, begin and end in the buffer).

    A long text is cut into pieces that overlap by ``length - 1`` bytes: every string lies in exactly one piece.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def close():
        sizes = np.array([len(p) for _, _, p in held])
        ends = np.cumsum(sizes)
        return b"".join(p for _, _, p in held), np.array([r for r, _, _ in held]), np.array([b for _, b, _ in held]), ends - sizes, ends

    for row, text in enumerate(texts):
        for base in range(0, len(text) - length + 1, BLOCK_BYTES):
            piece = text[base : base + BLOCK_BYTES + length - 1]
            if held and size + len(piece) > 2 * BLOCK_BYTES:
                yield close()
                held, size = [], 0
            held.append((row, base, piece))
            size += len(piece)
    if held:
        yield close()


def _parse(texts: list[bytes], rule: RepeatRule, hot: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases of the texts, block by block: trigger, fingerprint, row, place in the text, size.

    ``hot``: sorted triggers whose phrases are parsed into single strings; None: all are.
    """
    length, strings = rule.length, rule.length - rule.trigger + 1
    for buffer, rows, bases, begins, ends in _blocks(texts, length):
        hashes = _Hashes(buffer)
        triggers = hashes.fixed(rule.trigger)
        # The smallest hash of a string's triggers, and where it is; of equal ones the leftmost.
        least = (triggers & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(triggers), dtype=np.uint64)
        width = 1
        while width * 2 <= strings:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if strings > width:
            least = np.minimum(least[: len(least) - (strings - width)], least[strings - width :])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        change = np.ones(len(at), bool)
        change[1:] = at[1:] != at[:-1]
        change[begins] = True
        # The strings that begin in a piece's last bytes would run into the next piece.
        inside = np.zeros(len(at) + length, np.int32)
        np.add.at(inside, begins, 1)
        np.add.at(inside, ends - length + 1, -1)
        change &= np.cumsum(inside[: len(at)]) > 0
        first = np.flatnonzero(change)
        piece = np.searchsorted(ends, first, side="right")
        last = np.minimum(np.append(first[1:], len(at)), ends[piece] - length + 1) - 1
        trigger = triggers[at[first]]
        mark = hashes.of(first, last + length)
        size = (last + length - first).astype(np.int64)
        split = np.ones(len(first), bool) if hot is None else np.zeros(len(first), bool)
        if hot is not None and len(hot):
            place = np.minimum(np.searchsorted(hot, trigger), len(hot) - 1)
            split = hot[place] == trigger
        if split.any():
            count = (last - first + 1)[split]
            single = np.repeat(first[split], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            whole = ~split
            single_mark = hashes.of(single, single + length)
            turn = np.argsort(np.concatenate([first[whole], single]), kind="stable")
            trigger, mark, size, first, piece = (
                np.concatenate([a, b])[turn] for a, b in (
                    (trigger[whole], _mixed(single_mark)), (mark[whole], single_mark), (size[whole], np.full(len(single), length)),
                    (first[whole], single), (piece[whole], np.repeat(piece[split], count)),
                )
            )
        yield trigger, mark, rows[piece], first - begins[piece] + bases[piece], size


def _firsts(p: Phrases) -> tuple[Phrases, Phrases]:
    """Of equal phrases the earliest, and all later ones."""
    p = p.take(np.lexsort((p.start, p.text, p.doc, p.mark, p.trigger)))
    new = np.ones(len(p.mark), bool)
    new[1:] = (p.mark[1:] != p.mark[:-1]) | (p.trigger[1:] != p.trigger[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    same = (p.doc == p.doc[lead]) & (p.text == p.text[lead]) & (p.start == p.start[lead])
    return p.take(new), p.take(~same)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(keys) >> np.uint64(1)).astype(np.int64) % shards


ENTRIES, REPEATS, TEXTS = 0, 1, 2
_DEALT = "shard bigint, kind tinyint, data binary"


def _dealt(kind: int, shard: np.ndarray, pack) -> Iterator[pa.RecordBatch]:
    """One row per shard: ``pack`` makes its bytes from the rows that belong to it."""
    turn = np.argsort(shard, kind="stable")
    begins = np.flatnonzero(np.diff(shard[turn], prepend=-1))
    for i in range(0, len(begins), 1000):
        part = begins[i : i + 1000]
        ends = np.append(begins, len(turn))[i + 1 : i + 1 + len(part)]
        data = [pack(turn[a:b]) for a, b in zip(part, ends)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard[turn[part]], pa.int64()), pa.array(np.full(len(part), kind, np.int8), pa.int8()), pa.array(data, pa.binary())],
            ["shard", "kind", "data"],
        )


def _deal_phrases(p: Phrases, shards: int) -> Iterator[pa.RecordBatch]:
    first, later = _firsts(p)
    yield from _dealt(ENTRIES, _shard(first.trigger, shards), lambda rows: first.take(rows).pack())
    if len(later.doc):
        blank = np.zeros(len(later.doc), np.uint64)
        later = Phrases(blank, blank, later.doc, later.text, later.start, later.size)
        yield from _dealt(REPEATS, _shard(later.text.view(np.uint64), shards), lambda rows: later.take(rows).pack())


def _phrase_batches(batches, rule: RepeatRule, hot: np.ndarray) -> Iterator[Phrases]:
    """Phrases of record batches (id, hash of the text, text), about BATCH_PHRASES at a time, in no order."""
    for batch in batches:
        held, count = [], 0
        for part in text_slices(batch, 2):
            doc, text = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for trigger, mark, row, start, size in _parse(utf8(part.column(2)), rule, hot):
                held.append(Phrases(trigger, mark, doc[row], text[row], start, size))
                count += len(row)
                if count >= BATCH_PHRASES:
                    yield Phrases.joined(held)
                    held, count = [], 0
        if held:
            yield Phrases.joined(held)


def _hot_triggers(rows: DataFrame, rule: RepeatRule) -> np.ndarray:
    """Triggers with more different phrases than a shard should hold, at most HOT_LIST of them, by counts over all rows."""

    def count(batches):
        for p in _phrase_batches(batches, rule, np.zeros(0, np.uint64)):
            first, _ = _firsts(p)
            begins = np.flatnonzero(np.diff(first.trigger, prepend=first.trigger[:1] + np.uint64(1)))
            several = np.diff(np.append(begins, len(first.trigger)))
            many = several > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(first.trigger[begins[many]].view(np.int64), pa.int64()), pa.array(several[many], pa.int64())], ["trigger", "n"]
            )

    counted = rows.mapInArrow(count, "trigger bigint, n bigint").groupBy("trigger").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") > rule.hot_phrases).orderBy(F.desc("n")).limit(HOT_LIST).select("trigger").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


_FOUND = "repeat boolean, trigger bigint, doc bigint, text_hash bigint, start bigint, size int"


def _found(repeat: bool, p: Phrases) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(p.doc), repeat)), pa.array(p.trigger.astype(np.uint64).view(np.int64), pa.int64()), pa.array(p.doc, pa.int64()),
         pa.array(p.text, pa.int64()), pa.array(p.start, pa.int64()), pa.array(p.size.astype(np.int32), pa.int32())],
        ["repeat", "trigger", "doc", "text_hash", "start", "size"],
    )


def _dictionary(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Repeats, and the earliest of every phrase whose trigger has other phrases too."""
    first, later = _firsts(Phrases.unpack(blobs))
    yield _found(True, later)
    same = first.trigger[1:] == first.trigger[:-1]
    shared = np.zeros(len(first.trigger), bool)
    shared[1:] |= same
    shared[:-1] |= same
    yield _found(False, first.take(shared))


def _indexed(packed: list[bytes], rule: RepeatRule) -> pa.RecordBatch:
    """Repeats among phrases that come with their texts, by the run-length index of the shard."""
    heads, texts = [], []
    for data in packed:
        size = int.from_bytes(data[:8], "little")
        heads.append(data[8 : 8 + size])
        texts.append(data[8 + size :])
    p, text = Phrases.unpack(heads), np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(p.size, dtype=np.int64)
    # In the order of documents and places; a document that is there twice counts once.
    turn = np.lexsort((p.start, p.text, p.doc))
    q = p.take(turn)
    again = (q.doc[1:] == q.doc[:-1]) & (q.text[1:] == q.text[:-1]) & (q.start[1:] == q.start[:-1])
    turn = turn[np.append(True, ~again)] if len(turn) else turn
    p, ends = p.take(turn), ends[turn]
    size = p.size.astype(np.int64)
    begins = np.cumsum(size + 1) - size - 1
    laid = np.full(int((size + 1).sum()), SEPARATOR, np.uint8)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    laid[np.repeat(begins, size) + within] = text[np.repeat(ends - size, size) + within]
    repeated = RunIndex.build(laid).earliest(rule.length) < np.arange(len(laid))
    # Runs of repeated strings; a separator is never repeated, so a run stays in its phrase.
    edge = np.diff(repeated.astype(np.int8), prepend=0, append=0)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(begins, first, side="right") - 1
    zero = np.zeros(len(row), np.uint64)
    return _found(True, Phrases(zero, zero, p.doc[row], p.text[row], p.start[row] + first - begins[row], end - first + rule.length - 1))


def _resolve(dealt: DataFrame, rule: RepeatRule) -> DataFrame:
    """What the phrases of every shard tell: repeats, and phrases for the index."""

    def shard(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds, data = table.column("kind").to_numpy(), table.column("data").to_pylist()
        yield _found(True, Phrases.unpack([d for k, d in zip(kinds, data) if k == REPEATS]))
        yield from _dictionary([d for k, d in zip(kinds, data) if k == ENTRIES])
        yield _indexed([d for k, d in zip(kinds, data) if k == TEXTS], rule)

    return dealt.groupBy("shard").applyInArrow(lambda table: pa.Table.from_batches(list(shard(table))), _FOUND)


def _deal_texts(phrases: DataFrame, rule: RepeatRule, shards: int) -> DataFrame:
    """Cut the phrases (a list per document) out of the texts and deal them to shards of the index."""

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                wanted = part.column(3)
                counts = pc.list_value_length(wanted).to_numpy(zero_copy_only=False)
                flat = wanted.flatten()
                trigger, start, size, large = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                row = np.repeat(np.arange(part.num_rows), counts)
                texts = utf8(part.column(2))
                doc, text = (part.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
                cut = [texts[r][a : a + n] for r, a, n in zip(row.tolist(), start.tolist(), size.tolist())]
                p = Phrases(trigger.view(np.uint64), np.zeros(len(row), np.uint64), doc, text, start, size)

                def pack(rows):
                    head = p.take(rows).pack()
                    return len(head).to_bytes(8, "little") + head + b"".join(cut[i] for i in rows.tolist())

                small = np.flatnonzero(~large)
                yield from _dealt(TEXTS, _shard(p.trigger[small], shards), lambda rows, small=small: pack(small[rows]))
                big = np.flatnonzero(large)
                for key, mark, among, place, width in _parse([cut[i] for i in big.tolist()], rule, None):
                    of = p.take(big[among])
                    strings = Phrases(key, mark, of.doc, of.text, of.start + place, width)
                    yield from _deal_phrases(strings, shards)

    return phrases.mapInArrow(deal, _DEALT)


def repeat_spans(docs: DataFrame, rule: RepeatRule = RepeatRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated stretches: ``doc`` (null id: the least long), ``text_hash``, ``spans``, array of (start, size) in bytes.

    Documents without repeats have no row; spans may overlap and are in no order.
    """
    rows = _keyed(docs, id_col, text_col).drop("id")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // rule.shard_bytes))
    hot = docs.sparkSession.sparkContext.broadcast(_hot_triggers(rows, rule))

    def deal(batches):
        for p in _phrase_batches(batches, rule, hot.value):
            yield from _deal_phrases(p, shards)

    found = materialise(_resolve(rows.mapInArrow(deal, _DEALT), rule), "phrases")
    shared = found.filter(~F.col("repeat"))
    variants = shared.groupBy("trigger").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    large = variants.filter(F.col("n") > rule.index_phrases).select("trigger", F.lit(True).alias("large"))
    total = variants.agg(F.sum("bytes")).first()[0] or 0
    wanted = (
        shared.join(broadcast_if_small(large), "trigger", "left")
        .groupBy("doc", "text_hash")
        .agg(F.collect_list(F.struct("trigger", "start", "size", F.coalesce("large", F.lit(False)).alias("large"))).alias("wanted"))
    )
    texts = rows.join(wanted.hint("shuffle_hash"), ["doc", "text_hash"]).select("doc", "text_hash", "text", "wanted")
    indexed = _resolve(_deal_texts(texts, rule, max(1, -(-total // rule.index_bytes))), rule)
    repeats = found.union(indexed).filter("repeat")
    return repeats.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "size")).alias("spans"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


@F.arrow_udf(T.StructType([T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("kept", T.BinaryType())]))
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The spans joined to maximal runs, and the bytes outside them; null where there are no spans."""
    starts, ends, sizes, kept = [], [], [], []
    for text, found in zip(utf8(texts), spans):
        if not found.is_valid:
            sizes.append(0)
            kept.append(None)
            continue
        start = found.values.field(0).to_numpy(zero_copy_only=False)
        end = start + found.values.field(1).to_numpy(zero_copy_only=False)
        turn = np.argsort(start, kind="stable")
        start, through = start[turn], np.maximum.accumulate(end[turn])
        new = np.append(True, start[1:] > through[:-1])
        first = np.flatnonzero(new)
        start, end = start[first], through[np.append(first[1:], len(new)) - 1]
        places = [0, *np.stack([start, end], 1).ravel().tolist(), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(places[::2], places[1::2])))
        starts.append(start)
        ends.append(end)
        sizes.append(len(start))
    flat = pa.StructArray.from_arrays(
        [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (starts, ends)], ["start", "end"]
    )
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(kept, pa.binary())], ["spans", "kept"])


def strip_repeats(docs: DataFrame, rule: RepeatRule = RepeatRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``spans`` (removed runs: start and end in bytes) and ``kept``, the remaining bytes."""
    found = repeat_spans(docs, rule, id_col, text_col)
    rows = _keyed(docs, id_col, text_col)
    joined = rows.join(found.hint("shuffle_hash"), ["doc", "text_hash"], "left").withColumn("cut", _cut("text", "spans"))
    return joined.select(
        F.col("id").alias(id_col), F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.coalesce("cut.spans", F.array().cast(T.ArrayType(_SPAN))).alias("spans"), F.coalesce("cut.kept", F.col("text").cast("binary")).alias("kept"),
    )
