"""Stupid-backoff scores of documents under a word bigram model, by counting and joining.

S(v | u) = C(u v) / C(u) where the bigram was seen in training, else ``alpha`` * C(v) / N; the first word of
a document has C(v) / N; a document's score is the sum of the natural logarithms over its words. All
counts cover all training texts.

Without ``train`` the scored documents are the training texts too. A text is then scored under the counts of the
other folds alone, or every bigram would have been seen in the text itself. A text's fold follows from the MD5 of
its characters, so that exact copies share a fold and never vouch for each other.

Work is dealt by the hash of the n-gram: occurrences (context, word, document, fold) go to the bucket of their
context, which therefore holds all that is needed for C(u v) and C(u); only sums per document leave it. A word whose
bigram the other folds lack is joined to the table of word counts instead, and backs off.

Words that make up at least one in ``HOT_SHARE`` of all words (so at most ``HOT_SHARE`` of them) are set apart: their
counts are handed to all tasks, their occurrences as context are dealt by the next word, and by both words where that
is hot too. The pairs of such words that reach the same share (again at most ``HOT_SHARE``) are counted before the
shuffle and scored in the scan. No bucket holds more than that share of the text for one key; otherwise buckets hold
about ``BUCKET_ENTRIES`` occurrences, their number growing with the text.

Defined results: null and blank texts have no words and score 0; a word that training lacks counts
as seen once; rows that share an id are scored together, one result row per id (null is an id of its
own); an empty table gives an empty result. Words are lower-cased (A-Z) runs between white space and
are compared by 64-bit hashes.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import lists, text_slices, utf8
from docquarry.session import materialise

ALPHA = 0.4
HOT_SHARE = 1000
BUCKET_ENTRIES = 1_000_000
PART_ROWS = 20_000
MISSING_IN_ROW = 50_000

# Fold of a text: its MD5's first hexadecimal digit modulo FOLDS. Texts that only train are in fold FOLDS, texts that
# are only scored in fold APART.
FOLDS = 4
APART = -1
FOLD = f"cast(instr('0123456789abcdef', substr(md5(coalesce(text, '')), 1, 1)) % {FOLDS} AS int)"

NO_WORD = np.uint64(0)
_NULL_ID = -(1 << 63)

# Texts of one slice, so that a 16-bit number names one.
SLICE_ROWS = 30_000

# Occurrences of a slice in one bucket: each word (``keys``) with the words beside it, first those that follow it (as many as
# ``runs`` says), then those before it (``backs``); texts by their place in ``rows``. The word beside is a number (``codes``):
# none, the place of a hot word, or that it is the next one of ``others``.
_ENTRIES = (
    "bucket int, keys array<bigint>, runs array<int>, backs array<int>, codes array<smallint>, others array<bigint>, "
    "texts array<smallint>, rows array<bigint>, folds array<tinyint>, done array<bigint>, totals array<double>, backed array<bigint>, n array<bigint>"
)
_NONE, _RARE, _HOT = 0, 1, 2
_MAX_CODE = 32_767
_PARTS = (
    "part int, rows array<bigint>, totals array<double>, backed array<bigint>, n array<bigint>, "
    "words array<bigint>, lacking array<bigint>, folds array<tinyint>"
)
_KINDS = {"totals": pa.float64(), "folds": pa.int8(), "runs": pa.int32(), "backs": pa.int32(), "codes": pa.int16(), "texts": pa.int16()}


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and the number of words of each text."""
    hashes, sizes = [], []
    for text in utf8(texts):
        words = text.lower().split()
        hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        sizes.append(len(words))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def _bigrams(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    mixed = (contexts * np.uint64(0x9E3779B97F4A7C15)) ^ (words + np.uint64(0x632BE59BD9B4E019))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


class _Counts:
    """Counts per fold of a bounded set of n-grams."""

    def __init__(self, rows: list):
        keys = np.array([r["gram"] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.by_fold = np.array([r["by_fold"] for r in rows], np.int64).reshape(len(rows), FOLDS + 1)[order]

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Place of each n-gram, -1 where it is not in the set."""
        if not len(self.keys):
            return np.full(len(grams), -1)
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        return np.where(self.keys[at] == grams, at, -1)

    def held(self, at: np.ndarray, folds: np.ndarray) -> np.ndarray:
        return _others(self.by_fold, at, folds)


def _others(by_fold: np.ndarray, at: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """Counts outside the given folds."""
    own = np.where(folds == APART, 0, by_fold[at, np.maximum(folds, 0)])
    return by_fold.sum(1)[at] - own


def _counted(keys: np.ndarray, counts: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """For each entry how often its key occurs, among the entries that count, in other folds than its own."""
    kinds, at = np.unique(keys, return_inverse=True)
    cells = at[counts] * (FOLDS + 1) + folds[counts]
    by_fold = np.bincount(cells, minlength=len(kinds) * (FOLDS + 1)).reshape(len(kinds), FOLDS + 1)
    return _others(by_fold, at, folds)


def _pairs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, text) of every word and of the end of every text that has words; a text starts without context."""
    blocks = sizes + (sizes > 0)
    at = np.arange(len(words)) + np.repeat(np.cumsum(sizes > 0) - (sizes > 0), sizes)
    contexts, nexts = np.zeros(blocks.sum(), np.uint64), np.zeros(blocks.sum(), np.uint64)
    nexts[at], contexts[at + 1] = words, words
    return contexts, nexts, np.repeat(np.arange(len(sizes)), blocks)


def _sliced(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield from text_slices(batch.slice(start, SLICE_ROWS))


def _per_fold(grams: np.ndarray, folds: np.ndarray):
    """Partial counts: one row per n-gram and fold."""
    for fold in np.unique(folds):
        kinds, counts = np.unique(grams[folds == fold], return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds.view(np.int64)), pa.array(np.full(len(kinds), fold), pa.int32()), pa.array(counts, pa.int64())],
            ["gram", "fold", "n"],
        )


def _summed(partial: DataFrame) -> DataFrame:
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)) for k in range(FOLDS + 1)]
    return partial.groupBy("gram").agg(F.sum("n").alias("n"), F.array(*by_fold).alias("by_fold"))


def _column(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(frame: pa.Table, name: str, kind: type) -> np.ndarray:
    """All values of a list column."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in frame.column(name).chunks]
    return np.concatenate([np.zeros(0, kind), *parts]).astype(kind)


def _grouped(key: np.ndarray, columns: dict[str, np.ndarray], count: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Lists of the columns, one row for each key that occurs."""
    order, sizes = np.argsort(key, kind="stable"), np.bincount(key, minlength=count)
    used = np.flatnonzero(sizes)
    return used, {c: lists(v[order], sizes[used], _KINDS.get(c, pa.int64())) for c, v in columns.items()}


def _record(schema: str, key: np.ndarray | list, columns: dict[str, pa.Array]) -> pa.Table:
    """Rows with the given lists, the other lists of the schema empty."""
    first, *names = [field.split()[0] for field in schema.split(", ")]
    empty = np.zeros(len(key), np.int64)
    arrays = [columns.get(c, lists(empty[:0], empty, _KINDS.get(c, pa.int64()))) for c in names]
    return pa.table([pa.array(key, pa.int32()), *arrays], [first, *names])


def _packed(key: np.ndarray, contexts: np.ndarray, words: np.ndarray, after: np.ndarray, text: np.ndarray, ids: np.ndarray,
            folds: np.ndarray, buckets: int, hot: _Counts) -> pa.Table:
    """The occurrences dealt by key, a row per bucket. ``after``: the key's word is the context."""
    order = np.lexsort((~after, key))
    key, text, after = key[order], text[order], after[order]
    mine, others = np.where(after, contexts[order], words[order]), np.where(after, words[order], contexts[order])
    place = hot.find(others)
    codes = np.where((place >= 0) & (place <= _MAX_CODE - _HOT), place + _HOT, np.where(others == NO_WORD, _NONE, _RARE))
    rare = codes == _RARE
    # Monotone in the key, so equal keys and equal buckets lie together.
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    turn = np.ones(len(key), bool)
    turn[1:] = (mine[1:] != mine[:-1]) | (bucket[1:] != bucket[:-1])
    starts = np.flatnonzero(turn)
    follow = np.bincount(np.cumsum(turn)[after] - 1, minlength=len(starts))
    before = np.diff(starts, append=len(key)) - follow
    used, rank = np.unique(bucket, return_inverse=True)
    named, place = np.unique(rank * len(ids) + text, return_inverse=True)
    holder, name = named // max(len(ids), 1), named % max(len(ids), 1)
    of_entries, of_runs, of_texts, of_rare = (np.bincount(x, minlength=len(used)) for x in (rank, rank[starts], holder, rank[rare]))
    place = place - np.repeat(np.cumsum(of_texts) - of_texts, of_entries)
    lengths = {
        "keys": of_runs, "runs": of_runs, "backs": of_runs, "codes": of_entries, "others": of_rare, "texts": of_entries,
        "rows": of_texts, "folds": of_texts,
    }
    columns = {
        "keys": mine[starts].view(np.int64), "runs": follow.astype(np.int32), "backs": before.astype(np.int32),
        "codes": codes.astype(np.int16), "others": others[rare].view(np.int64), "texts": place.astype(np.int16), "rows": ids[name], "folds": folds[name].astype(np.int8),
    }
    return _record(_ENTRIES, used, {c: lists(x, lengths[c], _KINDS.get(c, pa.int64())) for c, x in columns.items()})


def _unpacked(frame: pa.Table, hot: _Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, row, fold) of all occurrences of a bucket."""
    sides = np.stack([_flat(frame, "runs", np.int64), _flat(frame, "backs", np.int64)], 1)
    mine = np.repeat(_flat(frame, "keys", np.int64).view(np.uint64), sides.sum(1))
    after = np.repeat(np.tile([True, False], len(sides)), sides.ravel())
    codes = _flat(frame, "codes", np.int64)
    others = np.full(len(codes), NO_WORD)
    others[codes == _RARE] = _flat(frame, "others", np.int64).view(np.uint64)
    others[codes >= _HOT] = hot.keys[codes[codes >= _HOT] - _HOT]
    sizes, named = (pc.list_value_length(frame.column(c)).to_numpy() for c in ("codes", "rows"))
    at = _flat(frame, "texts", np.int64) + np.repeat(np.cumsum(named) - named, sizes)
    rows, folds = _flat(frame, "rows", np.int64)[at], _flat(frame, "folds", np.int64)[at]
    return np.where(after, mine, others), np.where(after, others, mine), rows, folds


def _per_row(rows: np.ndarray, **values: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of the values per document."""
    ids, place = np.unique(rows, return_inverse=True)
    sums = {c: np.bincount(place, weights=v, minlength=len(ids)) for c, v in values.items()}
    return {"rows": ids, **{c: v if c == "totals" else v.astype(np.int64) for c, v in sums.items()}}


def _join_bucket(frame: pa.Table, hot: _Counts, totals: np.ndarray, alpha: float, parts: int) -> pa.Table:
    """Join the occurrences of a bucket to their counts: sums by part of the documents, and words to be joined to word counts."""
    contexts, words, rows, folds = _unpacked(frame, hot)
    first, end, counts = contexts == NO_WORD, words == NO_WORD, folds != APART
    pair = _counted(_bigrams(contexts, words), counts, folds)
    context = _counted(contexts, counts, folds)
    known = hot.find(contexts)
    context[known >= 0] = hot.held(known, folds)[known >= 0] if len(hot.keys) else 0

    asked = ~end & (folds != FOLDS)
    seen = asked & ~first & (pair > 0)
    back = asked & ~seen
    score = np.zeros(len(rows))
    score[seen] = np.log(pair[seen]) - np.log(context[seen])
    common = hot.find(words)
    score[back] = np.where(first[back], 0.0, log(alpha)) - np.log(np.maximum(_others(totals, np.zeros(back.sum(), int), folds[back]), 1))
    plain = back & (common >= 0)
    if plain.any():
        score[plain] += np.log(np.maximum(hot.held(common[plain], folds[plain]), 1))
    lacking = back & (common < 0)

    sums = _per_row(
        np.concatenate([rows[asked], _flat(frame, "done", np.int64)]),
        totals=np.concatenate([score[asked], _flat(frame, "totals", np.float64)]),
        backed=np.concatenate([(back & ~first)[asked], _flat(frame, "backed", np.int64)]),
        n=np.concatenate([np.zeros(asked.sum(), np.int64), _flat(frame, "n", np.int64)]),
    )
    part = (sums["rows"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % parts
    used, columns = _grouped(part, sums, parts)
    # In the order of the words, so that equal ones take little room where they are written and sent.
    lacking = np.flatnonzero(lacking)
    lacking = lacking[np.argsort(words[lacking], kind="stable")]
    missing = {"words": words[lacking].view(np.int64), "lacking": rows[lacking], "folds": folds[lacking].astype(np.int8)}
    block, lists_of = _grouped(np.arange(len(lacking)) // MISSING_IN_ROW, missing, 1)
    return pa.concat_tables([_record(_PARTS, used, columns), _record(_PARTS, [None] * len(block), lists_of)])


def _add_part(frame: pa.Table) -> pa.Table:
    """(row, total, backed, n) of the documents of one part."""
    values = {"totals": _flat(frame, "totals", np.float64), **{c: _flat(frame, c, np.int64) for c in ("backed", "n")}}
    sums = _per_row(_flat(frame, "rows", np.int64), **values)
    return pa.table({"row": sums["rows"], "total": sums["totals"], "backed": sums["backed"], "n": sums["n"]})


def backoff_scores(
    docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA,
    bucket_entries: int = BUCKET_ENTRIES,
) -> DataFrame:
    """Per id: ``n_words``, ``n_backoff`` (words scored by back-off), ``score`` (sum of logarithms).

    ``train`` gives the counts; without it they come from the documents of the other folds.
    """
    row = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NULL_ID))
    scored = docs.select(F.col(text_col).alias("text"), row.alias("row"))
    if train is None:
        texts = trained = scored.withColumn("fold", F.expr(FOLD))
    else:
        trained = train.select(F.col(text_col).alias("text"), F.lit(0).cast("bigint").alias("row"), F.lit(FOLDS).alias("fold"))
        texts = scored.withColumn("fold", F.lit(APART)).union(trained)

    def word_counts(batches):
        for batch in _sliced(batches):
            words, sizes = _words(batch.column(0))
            yield from _per_fold(words, np.repeat(_column(batch, "fold"), sizes))

    counts = materialise(_summed(trained.mapInArrow(word_counts, "gram bigint, fold int, n bigint")), "word-counts")
    sums = counts.agg(*[F.sum(F.get("by_fold", F.lit(k))) for k in range(FOLDS + 1)]).first()
    totals = np.array([[n or 0 for n in sums]], np.int64)
    total = int(totals.sum())
    frequent = F.col("n") * HOT_SHARE >= total
    hot = _Counts(counts.filter(frequent).collect())  # at most HOT_SHARE rows

    def pair_counts(batches):
        for batch in _sliced(batches):
            contexts, words, text = _pairs(*_words(batch.column(0)))
            both = (hot.find(contexts) >= 0) & (hot.find(words) >= 0)
            yield from _per_fold(_bigrams(contexts, words)[both], _column(batch, "fold")[text[both]])

    pairs = _summed(trained.mapInArrow(pair_counts, "gram bigint, fold int, n bigint"))
    hot_pairs = _Counts(pairs.filter(frequent).collect())  # at most HOT_SHARE rows
    buckets = max(1, ceil(total / bucket_entries))
    parts = max(1, ceil(docs.count() / PART_ROWS))

    def entries(batches):
        for batch in _sliced(batches):
            words, sizes = _words(batch.column(0))
            ids, fold_of = _column(batch, "row"), _column(batch, "fold")
            contexts, words, text = _pairs(words, sizes)
            rows, folds = ids[text], fold_of[text]
            u, v = hot.find(contexts), hot.find(words)
            first, end, asks = contexts == NO_WORD, words == NO_WORD, folds != FOLDS
            bigrams = _bigrams(contexts, words)
            pair = np.where((u >= 0) & (v >= 0), hot_pairs.find(bigrams), -1)
            # Scored here: pairs that are hot themselves, and hot words at the start of a text.
            here = (pair >= 0) | (first & (v >= 0))
            pick = np.flatnonzero(here & asks)
            start, fold = first[pick], folds[pick]
            held = np.zeros(len(pick), np.int64)
            if len(hot_pairs.keys):
                held[~start] = hot_pairs.held(pair[pick][~start], fold[~start])
            score, seen = np.zeros(len(pick)), held > 0
            if len(pick):
                score = np.log(np.maximum(hot.held(v[pick], fold), 1)) - np.log(np.maximum(_others(totals, fold * 0, fold), 1))
                score += np.where(start, 0.0, log(alpha))
                score[seen] = np.log(held[seen]) - np.log(hot.held(u[pick][seen], fold[seen]))
            counted = fold_of != FOLDS
            done = _per_row(
                np.concatenate([rows[pick], ids[counted]]), totals=np.concatenate([score, np.zeros(counted.sum())]),
                backed=np.concatenate([~seen & ~start, np.zeros(counted.sum(), bool)]),
                n=np.concatenate([np.zeros(len(pick), np.int64), sizes[counted]]),
            )
            done["done"] = done.pop("rows")
            if len(done["done"]):
                columns = {c: lists(x, [len(x)], _KINDS.get(c, pa.int64())) for c, x in done.items()}
                yield from _record(_ENTRIES, [int(done["done"][0]) % buckets], columns).to_batches()
            # The end of a text counts for its last word as context, which hot words do not need.
            left = np.flatnonzero(~here & ~(end & (u >= 0)) & ~(first & ~asks))
            after = (u < 0) & ~first | (u >= 0) & (v >= 0)
            key = np.where((u < 0) & ~first, contexts, np.where(v < 0, words, bigrams))
            packed = _packed(key[left], contexts[left], words[left], after[left], text[left], ids, fold_of, buckets, hot)
            yield from packed.to_batches()

    def joined(frame: pa.Table) -> pa.Table:
        return _join_bucket(frame, hot, totals, alpha, parts)

    dealt = texts.select("text", "row", "fold").mapInArrow(entries, _ENTRIES)
    found = materialise(dealt.groupBy("bucket").applyInArrow(joined, _PARTS), "bigram-scores", compression="zstd")
    by_part = found.filter("part IS NOT NULL").select("part", "rows", "totals", "backed", "n")
    sums = by_part.groupBy("part").applyInArrow(_add_part, "row bigint, total double, backed bigint, n bigint")
    missing = found.filter("part IS NULL").select(F.inline(F.arrays_zip("words", "lacking", "folds")))
    # Sorted on both sides at every size: words that are asked for can be many more than the counts. Words found once or
    # never elsewhere count as seen once, whose logarithm adds nothing; a text's own fold has the word at least once.
    several = counts.filter(F.col("n") > (2 if train is None else 1))
    asked = missing.join(several.hint("merge"), missing.words == several.gram)
    own = F.coalesce(F.get("by_fold", F.col("folds").cast("int")), F.lit(0))
    held = F.greatest(F.col("n") - own, F.lit(1))
    backed_off = asked.groupBy(F.col("lacking").alias("row")).agg(F.sum(F.log(held)).alias("total"))
    both = sums.union(backed_off.select("row", "total", F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))
    scores = both.groupBy("row").agg(F.sum("n").alias("n_words"), F.sum("backed").alias("n_backoff"), F.sum("total").alias("score"))
    row_id = F.when(F.col("row") != _NULL_ID, F.col("row")).cast(docs.schema[id_col].dataType)
    return scores.select(row_id.alias(id_col), "n_words", "n_backoff", "score")
