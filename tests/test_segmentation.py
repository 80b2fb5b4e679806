import math
import random

import pytest
from pyspark.sql import functions as F

from docquarry.catalog.lexical import han_words
from docquarry.operators import segmentation
from docquarry.operators.lexical import bm25_search, index_of
from docquarry.operators.segmentation import Dictionary, segment_words

LETTERS = "天地玄黄宇"


def all_cuts(run):
    if not run:
        yield []
    for end in range(1, len(run) + 1):
        for rest in all_cuts(run[end:]):
            yield [run[:end], *rest]


def test_best_path_equals_all_ways():
    random.seed(1)
    for _ in range(60):
        words = {"".join(random.choice(LETTERS) for _ in range(random.randint(1, 4))): random.randint(1, 50) for _ in range(12)}
        book, total = Dictionary(list(words.items())), sum(words.values())
        for _ in range(10):
            run = "".join(random.choice(LETTERS) for _ in range(random.randint(1, 9)))

            def cost(cut):
                each = [math.log(total / words[w]) if w in words else math.log(2 * total) if len(w) == 1 else math.inf for w in cut]
                return round(sum(each), 6), len(cut), [-len(w) for w in cut]

            got = list(book.cut(run))
            assert "".join(got) == run and cost(got)[:2] == min(map(cost, all_cuts(run)))[:2]


@pytest.mark.parametrize("longest, slice_chars", [(1, 10), (7, 1), (300, 100_000)])
def test_stretches_side_by_side_equal_one_path(monkeypatch, longest, slice_chars):
    """Many texts cut at once have the words that the path through every single run has."""
    monkeypatch.setattr(segmentation, "_LONGEST", longest)
    monkeypatch.setattr(segmentation, "_SLICE_CHARS", slice_chars)
    random.seed(2)
    for size in (0, 6, 14):
        words = ["".join(random.choice(LETTERS + "x") for _ in range(random.randint(1, 5))) for _ in range(size)]
        book = Dictionary([(w, random.randint(1, 50)) for w in dict.fromkeys(words)])
        runs = [["".join(random.choice(LETTERS + "日") for _ in range(random.randint(1, 30))) for _ in range(3)] for _ in range(40)]

        def one_by_one(run):
            ends, at = book._cut(run), 0
            while at < len(run):
                yield run[at : ends[at]]
                at = ends[at]

        want = [f" {' '.join(one_by_one(a))} x1 {' '.join(one_by_one(b))} \n {' '.join(one_by_one(c))} " for a, b, c in runs]
        got = book.spaced_all([None, "", *[f"{a}x1{b}\n{c}" for a, b, c in runs], "no Han"])
        assert got == [None, "", *want, "no Han"]


def test_search_by_words(spark):
    book = spark.createDataFrame([("北京", 50), ("天气", 40), ("今天", 60), ("北京大学", 20), ("大学", 30)], "word string, n long")
    docs = spark.createDataFrame([(1, "今天天气很好"), (2, "北京大学 in 北京"), (3, None), (4, "大学天")], "doc_id long, text string")
    cut = segment_words(docs, "text", book)
    assert {r.doc_id: (r.text or "").split() for r in cut.collect()} == {
        1: ["今天", "天气", "很", "好"], 2: ["北京大学", "in", "北京"], 3: [], 4: ["大学", "天"],
    }
    asked = segment_words(spark.createDataFrame([(1, "北京"), (2, "天气"), (3, "大学")], "query_id long, text string"), "text", book)
    hits = {(r.query_id, r.doc_id) for r in bm25_search(asked, index_of(cut, "doc_id", "text")).collect()}
    assert hits == {(1, 2), (2, 1), (3, 4)}  # the university of document 2 is a word of its own
    assert [r.text.split() for r in segment_words(docs.limit(1), "text", book.limit(0)).collect()] == [list("今天天气很好")]


def test_too_large_a_dictionary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(segmentation, "MAX_WORDS", 2)
    book = spark.createDataFrame([("一", 1), ("二", 1), ("三", 1)], "word string, n long")
    with pytest.raises(ValueError):
        segment_words(book, "word", book)


def test_query_keeps_every_character(spark):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.length(F.regexp_replace(F.lower("text"), "[^a-z]", "")).alias("n"))
    got = han_words(spark, folder).join(texts, "doc_id").collect()
    assert got and all(r.n_known <= r.n_words <= r.n for r in got) and sum(r.n_known for r in got) > 0
