"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a fixed mask over neighbouring words: the words at its ones are hashed, those at its zeros
are ignored, so a passage in which some words were replaced still shares seeds with the original.
Every position of every document and of every benchmark item is hashed under each mask. Equal hashes
name a document, an item and how far they are shifted against each other. Around each such hit the two
texts are laid on each other and compared word by word; the stretch with the best balance (a matching
word counts 1, another word costs ``penalty``) is the overlap, and it counts when it has enough
matching words. With a penalty of 3 an overlap holds fewer than one replaced word in four.

Items too short for every mask are hashed as whole word sequences, and documents are hashed at those lengths
too where such items exist; an item of less than ``min_matched`` words must stand in a document as it is.

The benchmark's hashes are broadcast when counted and found small, else joined by a shuffle. What
leaves a task is one row per document, item and shift.

Defined results: null and blank texts have no words; items of fewer than ``min_item_words`` words name no
passage and are never reported; repeated rows are reported once; rows without id are never reported;
empty tables give an empty result; words are compared in lower case (A-Z).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.common import let
from docquarry.llm.common import lowered
from docquarry.session import broadcast_if_small, materialise

# Positions of the ones of each mask: 11011011, 111001011, 10111011.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 7, 8), (0, 2, 3, 4, 6, 7))


@dataclass(frozen=True)
class SeedRules:
    """``min_matched``: matching words of an overlap, at most those of the item. ``min_item_words``: the shortest items looked for."""

    masks: tuple[tuple[int, ...], ...] = MASKS
    min_matched: int = 10
    penalty: int = 3
    min_item_words: int = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def seed_hashes(words: Column, masks: tuple[tuple[int, ...], ...]) -> Column:
    """Hashes of all masks at every word, one mask after the other per word. Past the end words are missing."""

    def at_each_word(hashed: Column) -> Column:
        seeds = [lambda i, m=m, mask=mask: F.xxhash64(F.lit(m), *[F.get(hashed, i + o) for o in mask]) for m, mask in enumerate(masks)]
        return F.flatten(F.transform(hashed, lambda _, i: F.array(*[seed(i) for seed in seeds])))

    return let(F.transform(words, lambda w: F.xxhash64(w)), at_each_word)


def _seeds(words: Column, masks: tuple[tuple[int, ...], ...]) -> list[Column]:
    return [F.posexplode(seed_hashes(words, masks)).alias("at", "seed")]


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    rows = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("item_words"))
    return rows.filter(F.col("item_id").isNotNull()).withColumn("length", F.size("item_words"))


def _whole_masks(items: DataFrame, rules: SeedRules) -> tuple[tuple[int, ...], ...]:
    """A mask without gaps for every length of items below the span of all masks (so at most a few lengths)."""
    shortest = min(max(mask) + 1 for mask in rules.masks)
    short = items.filter(F.col("length").between(max(1, rules.min_item_words), shortest - 1))
    return tuple(tuple(range(r["length"])) for r in short.select("length").distinct().orderBy("length").collect())


def seed_hits(docs: DataFrame, items: DataFrame, rules: SeedRules) -> DataFrame:
    """Distinct (id, item_id, shift, length): the item's first word would lie at word ``shift`` of the document."""
    masks = rules.masks + _whole_masks(items, rules)
    count = len(masks)
    span = F.get(F.array(*[F.lit(max(mask) + 1) for mask in masks]), F.col("mask"))
    known = items.select("item_id", "length", *_seeds(F.col("item_words"), masks))
    known = known.select(
        "item_id", "length", "seed", F.floor(F.col("at") / count).cast("int").alias("item_at"), (F.col("at") % count).alias("mask")
    ).filter((F.col("item_at") + span <= F.col("length")) & ((F.col("mask") < len(rules.masks)) | (span == F.col("length"))))
    known = materialise(known.drop("mask"), "item-seeds")
    placed = docs.select("id", *_seeds(words_of(F.col("text")), masks))
    met = placed.join(broadcast_if_small(known), "seed")
    shift = F.floor(F.col("at") / count).cast("int") - F.col("item_at")
    return met.select("id", "item_id", "length", shift.alias("shift")).distinct()


def _best_stretch(same: Column, rules: SeedRules) -> Column:
    """Over an array of booleans: matches, length and start of the stretch with the best balance, the first on ties."""
    zero = F.struct(*[F.lit(0).alias(n) for n in ("i", "score", "start", "hits", "best", "matched", "span", "first")])

    def step(s: Column, match: Column) -> Column:
        begin = s["score"] <= 0
        score = F.when(begin, 0).otherwise(s["score"]) + F.when(match, 1).otherwise(-rules.penalty)
        start = F.when(begin, s["i"]).otherwise(s["start"])
        hits = F.when(begin, 0).otherwise(s["hits"]) + match.cast("int")
        better = score > s["best"]
        return F.struct(
            (s["i"] + 1).alias("i"), score.alias("score"), start.alias("start"), hits.alias("hits"),
            F.when(better, score).otherwise(s["best"]).alias("best"), F.when(better, hits).otherwise(s["matched"]).alias("matched"),
            F.when(better, s["i"] - start + 1).otherwise(s["span"]).alias("span"), F.when(better, start).otherwise(s["first"]).alias("first"),
        )

    return F.aggregate(same, zero, step, lambda s: F.struct(s["matched"], s["span"], s["first"]))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", rules: SeedRules = SeedRules(),
) -> DataFrame:
    """Per document and item with a verified overlap: ids, ``n_matched``, ``n_span`` and ``start`` (word in the document)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull())
    items = _items(benchmark, item_id, item_text)
    hits = materialise(seed_hits(texts, items, rules), "seed-hits")
    per_document = hits.groupBy("id").agg(F.collect_list(F.struct("item_id", "length", "shift")).alias("hits"))
    near = texts.join(broadcast_if_small(per_document), "id")
    # The words under an item: null where it would reach over the document's ends.
    laid = near.select("id", F.explode(let(words_of(F.col("text")), lambda words: F.transform("hits", lambda hit: F.struct(
        hit["item_id"].alias("item_id"), hit["shift"].alias("shift"),
        F.transform(F.sequence(F.lit(0), hit["length"] - 1), lambda j: F.get(words, hit["shift"] + j)).alias("under"),
    )))).alias("hit")).select("id", "hit.*")
    compared = laid.join(broadcast_if_small(items.select("item_id", "item_words")), "item_id")
    same = F.zip_with("under", "item_words", lambda a, b: F.coalesce(a == b, F.lit(False)))
    needed = F.least(F.lit(rules.min_matched), F.size("item_words"))
    stretch = compared.select("id", "item_id", "shift", needed.alias("needed"), _best_stretch(same, rules).alias("s")).filter("s.matched >= needed")
    best = F.max(F.struct(
        F.col("s.matched").alias("n_matched"), (-F.col("s.span")).alias("span"), (-F.col("shift") - F.col("s.first")).alias("start")
    )).alias("best")
    return stretch.groupBy("id", "item_id").agg(best).select(
        F.col("id").alias(id_col), "item_id", F.col("best.n_matched").cast("long").alias("n_matched"),
        (-F.col("best.span")).cast("long").alias("n_span"), (-F.col("best.start")).cast("long").alias("start"),
    )


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SeedRules = SeedRules()
) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, with their own columns."""
    leaks = materialise(contaminated(docs, benchmark, id_col, text_col, rules=rules).select(id_col).distinct(), "leaks")
    return docs.join(broadcast_if_small(leaks), id_col, "left_anti").select(*docs.columns)
