"""Jaccard self-join on word n-grams by vertical partitioning.

All n-grams stand in one global order, their hash order, which is cut into fragments of equal width.
A document's n-grams are cut at the same places. Fragments are worked on apart from each other: each
counts the n-grams two documents share inside it, and the sum of these partial counts per pair is
the whole overlap that decides.

The first fragments (for a threshold of 0.9 a quarter of the order) also nominate the pairs. Inside them n-grams are reordered
by the number of documents that have them, rarest first; two documents that link must share an n-gram
among the first n - ceil(t n) + 1 of each (prefix filter), at places and with sizes that leave enough
room (position and length filters). A document whose rare n-grams fill its prefix needs no partner
search at all. Where a document has fewer n-grams in the first fragments than its prefix needs, the
prefix goes on in hash order.

Before the overlaps are counted, pairs meet a bound that is always right: documents carry the parity
of the number of their n-grams in each of 512 hash cells, and as many cells as differ, n-grams differ.

An n-gram in few prefixes nominates all its pairs. One in many (near copies by the thousand) nominates
only the pairs with two leaders: the document with the fewest rarer n-grams, and the one nearest to it
by the parity cells, which in a group of altered copies is the text they were made from. The components
of the links found so far then tell which pairs can still matter: those of different components, not
both in the leaders' one, that pass the same filters and the parity bound. Nothing is capped.

Exact copies (same word sequence) are one class and enter the join once, by their smallest id.

Defined results: null and blank texts have no n-grams and link with nothing; a text with fewer
words than n has its word sequence as its only n-gram; repeated rows (same id and text) each come
back; rows that give one id several texts get the component of the text with the smallest digest;
a null id links with nothing and its component is null; an empty table gives an empty result. Hashes have 64 bits
for n-grams and 128 for whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import lists, utf8
from docquarry.llm.components import components
from docquarry.session import broadcast_if_small, materialise, scratch_mark

FRAGMENTS = 8
CELLS = 512


@dataclass(frozen=True)
class JaccardJoin:
    """``n`` words per n-gram; link when ``percent`` * union <= 100 * overlap; ``few``: prefixes that are paired fully."""

    n: int = 3
    percent: int = 90
    few: int = 32

    @property
    def leading_end(self) -> int:
        """Where the fragments that nominate pairs end: they hold some 1.75 times the n-grams of a prefix."""
        leading = max(2, -(-FRAGMENTS * 7 * (100 - self.percent) // 400))
        return min(leading * (1 << 64) // FRAGMENTS, (1 << 64) - 1)

    def prefix(self, size: Column) -> Column:
        return size - F.ceil(size * self.percent / F.lit(100)) + 1

    def linked(self, overlap: Column, a: Column, b: Column) -> Column:
        return 100 * overlap >= self.percent * (a + b - overlap)


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """The distinct n-grams of a word sequence as sorted 64-bit hashes."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ h[i : len(h) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _sketch(texts: Column, join: JaccardJoin) -> Column:
    """Per text: class key, number of n-grams, number in the leading fragments, the head of the order, parities."""
    n, percent, end = join.n, join.percent, np.uint64(join.leading_end)
    kind = T.StructType([
        T.StructField("key", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("leading", T.LongType()),
        T.StructField("head", T.ArrayType(T.LongType(), False)), T.StructField("parity", T.ArrayType(T.LongType(), False)),
    ])

    @F.arrow_udf(kind)
    def sketch(column: pa.Array) -> pa.Array:
        keys, sizes, leading, heads, parity = [], [], [], [], []
        for text in utf8(column):
            words = text.lower().split()  # both for ASCII only
            grams = shingle_hashes(words, n)
            size = len(grams)
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if size else None)
            sizes.append(size)
            leading.append(int(np.searchsorted(grams, end)))
            prefix = size - -(-size * percent // 100) + 1 if size else 0
            heads.append(grams[: max(leading[-1], prefix)].view(np.int64))
            cells = np.bincount((grams >> np.uint64(7)).astype(np.int64) & (CELLS - 1), minlength=CELLS) & 1
            parity.append(np.packbits(cells.astype(np.uint8)).view(np.int64))
        rows = len(keys)
        return pa.StructArray.from_arrays(
            [
                pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(leading, pa.int64()),
                lists(np.concatenate(heads) if rows else np.zeros(0, np.int64), [len(h) for h in heads], pa.int64()),
                lists(np.concatenate(parity) if rows else np.zeros(0, np.int64), [CELLS // 64] * rows, pa.int64()),
            ],
            ["key", "size", "leading", "head", "parity"],
        )

    return sketch(texts)


def _segments(texts: Column, join: JaccardJoin) -> Column:
    """The n-grams of a text, one list per fragment."""
    n = join.n

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.LongType(), False), False))
    def cut(column: pa.Array) -> pa.Array:
        pivots = np.array([i * (1 << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)
        flat, sizes = [np.zeros(0, np.int64)], []
        for text in utf8(column):
            grams = shingle_hashes(text.lower().split(), n)
            sizes.extend(np.diff(np.searchsorted(grams, pivots), prepend=0, append=len(grams)).tolist())
            flat.append(grams.view(np.int64))
        inner = lists(np.concatenate(flat), sizes, pa.int64())
        offsets = np.arange(0, len(sizes) + 1, FRAGMENTS, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), inner)

    return cut(texts)


def _prefixes(nodes: DataFrame, join: JaccardJoin) -> DataFrame:
    """(gram, id, size, place): the n-grams of the documents' prefixes that more than one document has.

    ``place`` counts the document's n-grams that come earlier in its order.
    """
    # Only beyond the leading fragments the place is known yet; -1 stands for the rest.
    spelled = nodes.select("id", "leading", F.posexplode("head").alias("at", "gram")).select(
        "id", "gram", F.when(F.col("at") < F.col("leading"), -1).otherwise(F.col("at")).cast("long").alias("place")
    )
    shared = nodes.select(F.explode("head").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    common = spelled.join(shared, "gram")
    inside = F.col("place") < 0
    grouped = common.groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(inside, F.struct("df", "gram")))).alias("inside"),
        F.collect_list(F.when(~inside, F.struct("place", "gram"))).alias("beyond"),
    ).join(nodes.select("id", "size", "leading"), "id")
    # Within the leading fragments the n-grams of this document alone come first.
    alone = F.col("leading") - F.size("inside")
    placed = F.transform("inside", lambda x, i: F.struct((alone + i).alias("place"), x["gram"].alias("gram")))
    listed = grouped.select("id", "size", F.explode(F.concat(placed, "beyond")).alias("p")).select(
        F.col("p.gram").alias("gram"), "id", "size", F.col("p.place").alias("place")
    )
    return listed.filter(F.col("place") < join.prefix(F.col("size")))


def _may_link(join: JaccardJoin, a: str, b: str) -> Column:
    """Length and position filters for two rows that share an n-gram of their prefixes."""
    na, nb = F.col(f"{a}.size"), F.col(f"{b}.size")
    most = F.least(na - F.col(f"{a}.place"), nb - F.col(f"{b}.place"))
    return join.linked(F.least(na, nb), na, nb) & join.linked(most, na, nb)


def _pair(a: str, b: str) -> list[Column]:
    x, y = F.col(f"{a}.id"), F.col(f"{b}.id")
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _near(join: JaccardJoin, size_a: Column, size_b: Column, cells: Column) -> Column:
    """False only for pairs that cannot link: |a| + |b| - 2 overlap is at least the number of cells that differ."""
    return join.linked(F.floor((size_a + size_b - cells) / 2), size_a, size_b)


def _cells_apart(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, CELLS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _verified(pairs: DataFrame, facts: DataFrame, texts: DataFrame, join: JaccardJoin) -> DataFrame:
    """The pairs (a, b) that link, by partial overlaps of the fragments."""
    known = pairs.join(facts.toDF("a", "size_a", "parity_a"), "a").join(facts.toDF("b", "size_b", "parity_b"), "b")
    near = _near(join, F.col("size_a"), F.col("size_b"), _cells_apart(F.col("parity_a"), F.col("parity_b")))
    possible = materialise(known.filter(near).select("a", "b", "size_a", "size_b"), "pairs")
    wanted = possible.select(F.col("a").alias("id")).union(possible.select(F.col("b").alias("id"))).distinct()
    members = texts.join(broadcast_if_small(wanted), "id", "left_semi").dropDuplicates(["id"])
    segments = materialise(
        members.select("id", F.posexplode(_segments(F.col("text"), join)).alias("fragment", "grams")), "segments"
    )
    parts = possible.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    met = parts.join(segments.toDF("a", "fragment", "grams_a"), ["a", "fragment"]).join(
        segments.toDF("b", "fragment", "grams_b"), ["b", "fragment"]
    )
    partial = met.select("a", "b", F.size(F.array_intersect("grams_a", "grams_b")).alias("shared"))
    overlaps = partial.groupBy("a", "b").agg(F.sum("shared").alias("overlap"))
    summed = overlaps.join(possible, ["a", "b"])
    return summed.filter(join.linked(F.col("overlap"), F.col("size_a"), F.col("size_b"))).select("a", "b", "overlap")


def _led(long: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the members of long lists with their list's two leaders, and (gram, second) leaders."""
    first = long.groupBy("gram").agg(F.min(F.struct("place", "id")).alias("least")).select("gram", F.col("least.id").alias("leader"))
    leaders = first.join(facts.select(F.col("id").alias("leader"), F.col("parity").alias("theirs")), "leader")
    beside = long.join(broadcast_if_small(leaders), "gram").filter(F.col("id") != F.col("leader"))
    apart = F.struct(_cells_apart(F.col("parity"), F.col("theirs")).alias("cells"), "place", "id")
    second = materialise(beside.groupBy("gram").agg(F.min(apart).alias("least")).select("gram", F.col("least.id").alias("leader")), "leaders")
    both = long.select("gram", "id").join(broadcast_if_small(first.union(second)), "gram").filter(F.col("id") != F.col("leader"))
    return both.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")), second


def _left_over(long: DataFrame, second: DataFrame, found: DataFrame, join: JaccardJoin) -> DataFrame:
    """Pairs (a, b) of long lists that may join different components of the links found so far."""
    labels = components(found.select("a", "b"))
    placed = long.join(broadcast_if_small(labels.withColumnRenamed("node", "id")), "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    homes = second.join(labels.withColumnRenamed("node", "leader"), "leader", "left").select(
        "gram", F.coalesce("component", "leader").alias("home")
    )
    placed = materialise(placed.join(broadcast_if_small(homes), "gram"), "long-lists")
    away = placed.filter(F.col("component") != F.col("home")).alias("x")
    open_pair = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.home")) | (F.col("x.id") < F.col("y.id")))
    near = _near(join, F.col("x.size"), F.col("y.size"), _cells_apart(F.col("x.parity"), F.col("y.parity")))
    met = away.join(placed.alias("y"), (F.col("x.gram") == F.col("y.gram")) & open_pair & _may_link(join, "x", "y") & near)
    return met.select(*_pair("x", "y")).distinct()


def links(nodes: DataFrame, texts: DataFrame, join: JaccardJoin = JaccardJoin()) -> DataFrame:
    """Links (a, b, overlap) whose components are those of all links; ``nodes`` are class representatives.

    Of the links inside a component that a frequent n-gram's leaders hold together not all are listed.
    """
    facts = nodes.select("id", "size", "parity")
    prefixes = materialise(_prefixes(nodes, join), "prefixes")
    lists_of = materialise(prefixes.groupBy("gram").agg(F.count("*").alias("members")).filter("members > 1"), "lists")
    listed = prefixes.join(broadcast_if_small(lists_of), "gram")
    short = listed.filter(F.col("members") <= join.few)
    near = short.alias("x").join(short.alias("y"), "gram").filter((F.col("x.id") < F.col("y.id")) & _may_link(join, "x", "y"))
    long = materialise(listed.filter(F.col("members") > join.few).join(facts.select("id", "parity"), "id"), "long-lists")
    led, second = _led(long, facts)
    first = materialise(_verified(near.select(*_pair("x", "y")).union(led).distinct(), facts, texts, join), "links")
    return first.union(materialise(_verified(_left_over(long, second, first, join), facts, texts, join), "links"))


def jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: JaccardJoin = JaccardJoin()
) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id reachable by links, its own included)."""
    sketched = materialise(docs.select(F.col(id_col).alias("id"), _sketch(F.col(text_col), join).alias("s")).select("id", "s.*"), "sketches")
    full = sketched.filter("key IS NOT NULL AND id IS NOT NULL")
    ids = full.select("id", "key").distinct()
    one_text = ids.groupBy("id").agg(F.min("key").alias("key"))
    if ids.count() == one_text.count():
        one_text = ids
    classes = materialise(one_text.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    single = full.join(broadcast_if_small(classes.select("key", F.col("rep").alias("id"))), ["key", "id"], "left_semi")
    nodes = single.dropDuplicates(["key"]) if full.count() > ids.count() else single
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = components(links(nodes, texts, join).select("a", "b"))
    labels = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        "key", F.coalesce("component", "rep").alias("component")
    )
    by_id = one_text.join(labels, "key").select("id", "component")
    return sketched.join(broadcast_if_small(by_id), "id", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: JaccardJoin = JaccardJoin()) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without id stay."""
    mark = scratch_mark()
    groups = materialise(jaccard_groups(docs, id_col, text_col, join), "groups", release_since=mark)
    dropped = groups.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(broadcast_if_small(dropped), id_col, "left_anti").select(*docs.columns)
