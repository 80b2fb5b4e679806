"""Tokens, token counts, prompt templates and text measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.common import as_column, let

# Word separator, Han range, default rerank instruction.
NON_WORD = r"[^\p{L}\p{N}]+"
HAN = "[一-鿿]"
# Tokens handled at a time inside a task, whatever the length of an Arrow batch.
SLICE_TOKENS = 500_000
DEFAULT_INSTRUCTION = "Given a web search query, retrieve relevant passages that answer the query"


def tokenize(text: str | Column, han_bigrams: bool = False) -> Column:
    """Lower-cased runs of letters and digits; optionally runs of Han characters become bigrams.

    Stands in for a segmenting analyzer: words of spaced scripts are the same, Han words are
    approximated by overlapping pairs.
    """
    lowered = F.lower(as_column(text))
    if not han_bigrams:
        return F.array_remove(F.split(lowered, NON_WORD), "")
    pieces = F.regexp_extract_all(
        lowered, F.lit(r"[一-鿿]+|[\p{L}\p{N}&&[^一-鿿]]+"), F.lit(0)
    )

    def pairs(token: Column) -> Column:
        return F.when(
            token.rlike(HAN) & (F.length(token) > 1),
            F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2))),
        ).otherwise(F.array(token))

    return F.flatten(F.transform(pieces, pairs))


def list_slices(lists: pa.Array, values: int = SLICE_TOKENS) -> Iterator[slice]:
    """Consecutive lists of a batch with about so many values, one list at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(lists.value_lengths(), 0), dtype=np.int64))
    first = done = 0
    while first < len(ends):
        stop = max(int(np.searchsorted(ends, done + values, side="right")), first + 1)
        yield slice(first, stop)
        first, done = stop, int(ends[stop - 1])


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, counted inside the row.

    The tokens of a document are in one row already, so counting them needs no shuffle: sort,
    find where each run starts, and take the differences of the starts.
    """

    def count(ordered: Column) -> Column:
        marked = F.transform(ordered, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
        starts = F.filter(
            marked, lambda p: (p["pos"] == 0) | (p["term"] != F.get(ordered, p["pos"] - 1))
        )
        return let(
            starts,
            lambda runs: F.transform(
                runs,
                lambda p, j: F.struct(
                    p["term"].alias("term"),
                    (F.coalesce(F.get(runs, j + 1)["pos"], F.size(ordered)) - p["pos"]).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(tokens), count)


def _counted(lists: pa.Array) -> pa.Array:
    """Lists of tokens to lists of (term, tf) in the order of the terms' bytes; a null list gives an empty one."""
    sizes = np.asarray(pc.fill_null(lists.value_lengths(), 0), dtype=np.int64)
    named = lists.flatten().dictionary_encode()
    n = max(len(named.dictionary), 1)
    order = np.asarray(pc.sort_indices(named.dictionary))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    keys = np.sort(np.repeat(np.arange(len(sizes)), sizes) * n + rank[np.asarray(named.indices)])
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    tf = np.diff(np.append(starts, len(keys))).astype(np.int32)
    rows, terms = keys[starts] // n, named.dictionary.take(pa.array(order[keys[starts] % n]))
    ends = np.cumsum(np.bincount(rows, minlength=len(sizes)))
    pairs = pa.StructArray.from_arrays([terms.cast(pa.string()), pa.array(tf)], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pairs)


def counted_terms():
    """UDF with the result of ``term_counts``, for whole tables: Arrow counts a batch in half the time the lambdas take."""

    @F.arrow_udf("array<struct<term: string, tf: int>>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_counted(batch[part]) for part in list_slices(batch)]
            yield pa.concat_arrays(parts) if parts else _counted(batch)

    return count


def whitespace_tokens(text: str | Column) -> Column:
    """Number of whitespace-separated tokens (the usage measure)."""
    return F.size(F.array_remove(F.split(as_column(text), r"\s+"), ""))


def has_han(text: str | Column) -> Column:
    return as_column(text).rlike(HAN)


def rerank_prompt(query: str | Column, document: str | Column, instruction: str | Column | None = None) -> Column:
    """Pair prompt; an empty or null instruction takes the default."""
    given = F.lit(None).cast("string") if instruction is None else as_column(instruction)
    chosen = F.coalesce(F.nullif(given, F.lit("")), F.lit(DEFAULT_INSTRUCTION))
    return F.concat(
        F.lit("<Instruct>: "), chosen,
        F.lit("\n<Query>: "), as_column(query),
        F.lit("\n<Document>: "), as_column(document),
    )


def query_prompt(text: str | Column, instruction: str | Column) -> Column:
    """Query-side embedding input; without an instruction the text is used as it is."""
    text, instruction = as_column(text), as_column(instruction)
    return F.when(
        F.coalesce(instruction, F.lit("")) != "",
        F.concat(F.lit("Instruct: "), instruction, F.lit("\nQuery: "), text),
    ).otherwise(text)


def token_overlap(left: str | Column, right: str | Column) -> Column:
    """Jaccard similarity of the two token sets; 0 when both are empty.

    A deterministic stand-in for a pair-scoring model, not a semantic score.
    """
    a, b = F.array_distinct(tokenize(left)), F.array_distinct(tokenize(right))

    def ratio(pair: Column) -> Column:
        shared = F.size(F.array_intersect(pair["a"], pair["b"]))
        total = F.size(pair["a"]) + F.size(pair["b"]) - shared
        return F.when(total > 0, shared.cast("double") / total).otherwise(F.lit(0.0))

    return let(F.struct(a.alias("a"), b.alias("b")), ratio)
