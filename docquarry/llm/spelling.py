"""Spelling variants: words of a vocabulary that differ by one letter, by bit-sliced position indexes.

A block of the vocabulary is indexed by one bit per word for every (position, letter). A query word is run over all words
of its block at once, 64 to a machine word: one set holds the words that agree so far, three more those with exactly
one replaced, one additional or one missing letter. With the next letter of the query each set is combined with the
bits of that letter at the same position, one further or one before. The sets of many queries are advanced together.

Blocks: two words that differ by one letter, the shorter of length L, share the first ``L // 2`` letters or the last
``L - L // 2`` (the change lies in one of the two parts). A word is put into the four blocks this allows it; pairs
that share both parts count in the first block only, which the set of agreeing words after ``L // 2`` letters tells.
A block with more than ``TILE`` words is dealt to square tiles, so that no task holds all of it.

The vocabulary is counted inside the scan before it is shuffled: a word in every document costs a row per task.

Defined results: null texts hold no words, a null id is written as empty in the checksum of a run; repeated rows
count as often as they are there; words of any length are compared whole; a word without a neighbour has no form and is
its own root; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import utf8
from docquarry.session import materialise

TILE = 2048
SHARD_ENTRIES = 1 << 16
HELD_WORDS = 1 << 20

# A run is of the letters [A-Za-zÀ-ÿ], here in lower-cased UTF-8.
_RUN = re.compile(rb"[a-z]+(?:\xc3[\x80-\xbf][a-z]*)*|(?:\xc3[\x80-\xbf][a-z]*)+")
_DAMAGE = 97


def _words_of(text: bytes, doc: int | None) -> Iterator[tuple[bytes, int]]:
    """The words of a text with their counts: lower-cased runs, some of them without one letter (told by a checksum)."""
    seed = zlib.crc32(b"%s:" % (b"" if doc is None else b"%d" % doc))
    for run, n in Counter(_RUN.findall(text.lower())).items():
        checksum = zlib.crc32(run, seed)
        if checksum % _DAMAGE == 0:
            letters = run.decode()
            at = checksum % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        yield run, n


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: the words of all texts with at least so many letters and occurrences."""

    def count(batches):
        held: dict[bytes, int] = {}

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )
            held.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                for word, n in _words_of(text, doc):
                    if len(word) >= min_length:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col))
    counted = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.char_length("word") >= min_length) & (F.col("n") >= min_count))


class BitIndex:
    """Bits of words (rows of code points, 0 past the end) per position and letter."""

    def __init__(self, letters: np.ndarray):
        self.width = -(-len(letters) // 64)
        self.lengths = (letters != 0).sum(1)
        self.alphabet = np.unique(letters[letters != 0])
        positions = letters.shape[1] + 1
        # The last letter stands for all others: no word has it.
        self.bits = np.zeros((positions, len(self.alphabet) + 1, self.width), np.uint64)
        for j in range(letters.shape[1]):
            self.bits[j, :-1] = packed(letters[:, j][None] == self.alphabet[:, None])

    def of_length(self, length: int) -> np.ndarray:
        return packed((self.lengths == length)[None])[0]

    def near(
        self, queries: np.ndarray, among: np.ndarray, replaced: bool = True, longer: bool = True, shorter: bool = True, beyond: int | None = None
    ) -> np.ndarray:
        """Per query (all of one length; rows of code points) the bits of the words in ``among`` that differ by one letter.

        ``replaced``, ``longer``, ``shorter``: which words to report, seen from the query. ``beyond``: leave out words that
        agree with the query in so many first letters.
        """
        length = queries.shape[1]
        code = np.searchsorted(self.alphabet, queries)
        known = code < len(self.alphabet)
        known &= self.alphabet[np.where(known, code, 0)] == queries if len(self.alphabet) else known
        code = np.where(known, code, len(self.alphabet))
        equal, none = among, np.zeros_like(among)
        other, more, less = none, none, none
        agreed = among if beyond == 0 else None
        for j in range(length):
            here = self.bits[j, code[:, j]] if j < len(self.bits) else none
            if replaced:
                other = (other & here) | (equal & ~here)
            if longer:
                more = (more | equal) & (self.bits[j + 1, code[:, j]] if j + 1 < len(self.bits) else none)
            if shorter:
                less = (less & self.bits[j - 1, code[:, j]] if 0 < j <= len(self.bits) else none) | equal
            equal = equal & here
            if j + 1 == beyond:
                agreed = equal
        found = none
        if replaced:
            found = found | (other & self.of_length(length))
        if longer:
            found = found | ((more | equal) & self.of_length(length + 1))
        if shorter:
            found = found | (less & self.of_length(length - 1))
        return found if agreed is None else found & ~agreed


def packed(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    width = -(-flags.shape[1] // 64)
    out = np.zeros((len(flags), width * 8), np.uint8)
    out[:, : -(-flags.shape[1] // 8)] = np.packbits(flags, axis=1, bitorder="little")
    return out.view(np.uint64)


def unpacked(bits: np.ndarray, count: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")[:, :count].astype(bool)


def _tile(words: np.ndarray, group: np.ndarray, asks: np.ndarray, answers: np.ndarray, least: int, last: bool):
    """Neighbours inside each group: (row of the query, row of the neighbour) for words of lengths ``least`` and one more."""
    letters = words.astype(f"U{least + 1}").view(np.uint32).reshape(len(words), least + 1)
    lengths = (letters != 0).sum(1)
    indexed = np.flatnonzero(answers)
    index = BitIndex(letters[indexed])
    members = packed(group[indexed][None] == np.arange(group.max() + 1)[:, None]) if len(group) else None
    for length in (least, least + 1):
        rows = np.flatnonzero(asks & (lengths == length))
        if not len(rows) or not len(indexed):
            continue
        short = length == least
        found = index.near(
            letters[rows, :length], members[group[rows]], replaced=short, longer=short, shorter=not short, beyond=least // 2 if last else None
        )
        query, word = np.nonzero(unpacked(found, len(indexed)))
        yield rows[query], indexed[word]


def _best(words: np.ndarray, n: np.ndarray, query: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """Per query its number of neighbours and the most frequent of them, of equally frequent ones the first."""
    turn = np.lexsort((words[near], -n[near], query))
    query, near = query[turn], near[turn]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    return pa.RecordBatch.from_arrays(
        [pa.array(words[query[first]].tolist(), pa.string()), pa.array(np.diff(np.append(first, len(query))), pa.int64()),
         pa.array(-n[near[first]], pa.int64()), pa.array(words[near[first]].tolist(), pa.string())],
        ["word", "n_near", "less", "form"],
    )


def neighbours(words: DataFrame, tile: int = TILE) -> DataFrame:
    """Per word with neighbours: ``n_near``, and ``form`` with ``form_n``, the most frequent neighbour. ``words``: word, n (distinct)."""
    length = F.char_length("word")
    half = (F.col("least") / 2).cast("int")
    entries = (
        words.select("word", "n", F.explode(F.array(length, length - 1)).alias("least"))
        .select("word", "n", "least", F.posexplode(F.array(F.substring("word", 1, half), F.expr("right(word, least - cast(least / 2 AS int))"))).alias("last", "part"))
    )
    block = ["least", "last", "part"]
    # A block without words of its shorter length has no pairs.
    sizes = entries.groupBy(*block).agg(F.count("*").alias("size"), F.count_if(length == F.col("least")).alias("short"))
    sizes = sizes.filter("size > 1 AND short > 0").drop("short")
    sized = entries.join(sizes, block).withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    whole = F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("column"), F.lit(True).alias("asks"), F.lit(True).alias("answers")))

    def copies(asks: bool):
        row, column = (lambda t: own, lambda t: t) if asks else (lambda t: t, lambda t: own)
        return F.transform(every, lambda t: F.struct(row(t).alias("row"), column(t).alias("column"), F.lit(asks).alias("asks"), F.lit(not asks).alias("answers")))

    dealt = sized.select("*", F.explode(F.when(F.col("tiles") == 1, whole).otherwise(F.concat(copies(True), copies(False)))).alias("t")).select(
        "word", "n", "least", "last", "part", "t.*"
    )
    materialised = materialise(dealt, "spelling-entries")
    shards = max(1, -(-materialised.count() // SHARD_ENTRIES))
    schema = "word string, n_near bigint, less bigint, form string"

    def search(table: pa.Table) -> pa.Table:
        out = [pa.RecordBatch.from_pylist([], pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("form", pa.string())]))]
        table = table.sort_by([(c, "ascending") for c in ("least", "last", "part", "row", "column")])
        least, last, row, column = (table.column(c).to_numpy() for c in ("least", "last", "row", "column"))
        part = table.column("part").combine_chunks().dictionary_encode().indices.to_numpy()
        edge = np.ones(len(table), bool)
        edge[1:] = (np.diff(least) != 0) | (np.diff(last) != 0) | (np.diff(part) != 0) | (np.diff(row) != 0) | (np.diff(column) != 0)
        begins = np.append(np.flatnonzero(edge), len(table))
        at = 0
        while at < len(begins) - 1:
            # Several whole groups of one length and side share a tile.
            upto = at + 1
            while upto < len(begins) - 1 and begins[upto + 1] - begins[at] <= tile and (
                least[begins[upto]] == least[begins[at]] and last[begins[upto]] == last[begins[at]]
            ):
                upto += 1
            rows = table.slice(begins[at], begins[upto] - begins[at])
            words = np.array(rows.column("word").to_pylist())
            n, asks, answers = (rows.column(c).to_numpy() for c in ("n", "asks", "answers"))
            group = np.cumsum(edge[begins[at] : begins[upto]]) - 1
            pairs = list(_tile(words, group, asks, answers, int(least[begins[at]]), bool(last[begins[at]])))
            if pairs:
                out.append(_best(words, n, *(np.concatenate(c) for c in zip(*pairs))))
            at = upto
        return pa.Table.from_batches(out)

    sharded = materialised.withColumn("shard", F.pmod(F.xxhash64(*block, "row", "column"), F.lit(shards)))
    found = sharded.groupBy("shard").applyInArrow(lambda table: search(table.drop_columns(["shard"])), schema)
    each = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    return each.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the end of every chain of forms, by doubling. A form is at least twice as frequent: no cycles."""
    steps = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = materialise(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if not steps.agg(F.max("moved")).first()[0]:
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def spelling_groups(
    docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE
) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` for the vocabulary of all texts.

    ``form``: the most frequent neighbour, if it is at least ``ratio`` (2 or more) times as frequent; ``root``: the
    form's form and so on to the last.
    """
    words = materialise(vocabulary(docs, min_length, min_count, id_col, text_col), "vocabulary")
    near = words.join(neighbours(words, tile), "word", "left")
    chosen = F.col("form_n") >= ratio * F.col("n")
    near = materialise(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(chosen, F.col("form")).alias("form"),
        F.when(chosen, F.col("form_n")).alias("form_n"),
    ), "spelling-forms")
    return near.join(_roots(near.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))
