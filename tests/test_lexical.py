import math
import random
import re
from collections import Counter
from dataclasses import replace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docquarry.operators import lexical
from docquarry.params import Bm25Params, read_params

DOCS = [
    (1, "the cat sat on the mat"), (2, "the dog sat"), (3, "cat cat cat"), (4, ""), (5, "a bird and a cat"),
    (6, "the dog sat"), (7, "!!! ..."),
]
QUERIES = [(1, "cat"), (2, "dog sat dog"), (3, "unknown words"), (4, ""), (5, "the cat and the bird")]


def brute_bm25(docs, queries, k, k1=1.3, b=0.6):
    tokens = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in docs}
    tokens = {i: t for i, t in tokens.items() if t}
    n, average = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(term for t in tokens.values() for term in set(t))
    hits = []
    for q, text in queries:
        scores = {}
        for term in re.findall(r"[^\W_]+", text.lower()):
            for i, t in tokens.items():
                tf = t.count(term)
                if tf:
                    idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                    scores[i] = scores.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / average))
        best = sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))[:k]
        hits += [(q, r, i, round(s, 6)) for r, (i, s) in enumerate(best, 1)]
    return sorted(hits)


def frames(spark, docs=DOCS, queries=QUERIES):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(queries, "query_id long, text string"),
    )


def found(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


def random_corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, weights=range(40, 0, -1), k=rng.randint(0, 30)))) for i in range(n)]
    queries = [(i, " ".join(rng.choices(words, k=4))) for i in range(8)]
    return docs, queries


@pytest.mark.parametrize("corpus", [(DOCS, QUERIES), random_corpus()])
def test_scan_join_and_stored_search_equal_brute_force(spark, tmp_path, monkeypatch, corpus):
    docs, queries = frames(spark, *corpus)
    want = brute_bm25(*corpus, k=3)
    index = lexical.index_of(docs, "doc_id", "text")
    assert found(lexical.bm25_search(queries, index, 3)) == want
    assert found(lexical.bm25_search(queries, replace(index, forward=None), 3)) == want
    stored = lexical.write_index(docs, "doc_id", "text", str(tmp_path / "index"))
    for share in (0.0, 1e9):  # always by scan, always by join
        monkeypatch.setattr(lexical, "SELECTIVE_SHARE", share)
        assert found(lexical.bm25_search(queries, stored, 3)) == want
    assert read_params(spark, Bm25Params, str(tmp_path / "index/params")) == Bm25Params()


def test_appended_index_equals_whole_index(spark, tmp_path):
    path = str(tmp_path / "index")
    docs, queries = frames(spark)
    lexical.write_index(docs.filter("doc_id <= 3"), "doc_id", "text", path)
    index = lexical.write_index(docs.filter("doc_id > 3"), "doc_id", "text", path, mode="append")
    assert found(lexical.bm25_search(queries, index, 3)) == brute_bm25(DOCS, QUERIES, 3)
    with pytest.raises(ValueError):
        lexical.write_index(docs, "doc_id", "text", path, mode="merge")


def test_append_changes_nothing_when_repeated_and_keeps_the_parameters(spark, tmp_path):
    path, params = str(tmp_path / "index"), Bm25Params(2.0, 0.1)
    docs, queries = frames(spark)
    lexical.write_index(docs, "doc_id", "text", path, params)
    index = lexical.write_index(docs, "doc_id", "text", path, mode="append")
    assert index.params == params and index.collection.first().n_docs == 5
    assert found(lexical.bm25_search(queries, index, 3)) == brute_bm25(DOCS, QUERIES, 3, 2.0, 0.1)
    with pytest.raises(ValueError):
        lexical.write_index(docs, "doc_id", "text", path, Bm25Params(), mode="append")


@pytest.mark.parametrize("share", [0.0, 1e9])
def test_upsert_and_delete_equal_a_new_index(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(lexical, "SELECTIVE_SHARE", share)
    path = str(tmp_path / "index")
    docs, queries = frames(spark)
    lexical.write_index(docs, "doc_id", "text", path)
    changed = [(3, "cat dog"), (5, "a bird and a cat"), (8, "the bird sat")]
    left = [(1, DOCS[0][1]), (3, "cat dog"), (5, "a bird and a cat"), (6, "the dog sat"), (8, "the bird sat"), (4, "")]
    for _ in range(2):
        lexical.write_index(spark.createDataFrame(changed, "doc_id long, text string"), "doc_id", "text", path, mode="upsert")
        index = lexical.delete_from_index(spark.createDataFrame([(2,), (7,), (99,)], "doc_id long"), path, "doc_id")
        assert found(lexical.bm25_search(queries, index, 3)) == brute_bm25(left, QUERIES, 3)
    assert {r.term: r.df for r in index.terms.collect()}["cat"] == 3


@pytest.mark.parametrize("stored", [True, False])
def test_restricted_search_counts_its_part_alone(spark, tmp_path, stored):
    docs, queries = frames(spark)
    docs = docs.selectExpr("*", "CASE WHEN doc_id IN (3, 6, 7) THEN 'A' ELSE 'B' END AS base")
    if stored:
        index = lexical.write_index(docs, "doc_id", "text", str(tmp_path / "index"), keep=("base",))
    else:
        index = lexical.index_of(docs, "doc_id", "text", keep=("base",))
    part = [d for d in DOCS if d[0] not in (3, 6, 7)]
    assert found(lexical.bm25_search(queries, index, 3, where=F.col("base") == "B")) == brute_bm25(part, QUERIES, 3)
    assert lexical.bm25_search(queries, index, 3, where=F.col("base") == "C").count() == 0


def test_han_text_is_found(spark, tmp_path):
    docs = [(1, "今天天气怎么样"), (2, "我们明天去北京"), (3, "hello 北京 world")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "北京"), (2, "天气"), (3, "京")], "query_id long, text string")
    index = lexical.write_index(frame, "doc_id", "text", str(tmp_path / "index"), Bm25Params(han_bigrams=True))
    hits = {(r.query_id, r.doc_id) for r in lexical.bm25_search(queries, index).collect()}
    assert hits == {(1, 2), (1, 3), (2, 1)}


def test_a_term_of_all_documents_is_kept_by_both_paths(spark, monkeypatch):
    docs = [(i, "same " + "word " * (i % 3)) for i in range(50)]
    frame, queries = frames(spark, docs, [(1, "same")])
    index = lexical.index_of(frame, "doc_id", "text")
    monkeypatch.setattr(lexical, "SCORE_DIGITS", 1)
    monkeypatch.setattr("docquarry.operators.common.SCORE_DIGITS", 1)
    both = [found(lexical.bm25_search(queries, i, 40)) for i in (index, replace(index, forward=None))]
    assert both[0] == both[1] and len(both[0]) == 40 and {r[3] for r in both[0]} == {0.0}


def test_search_beyond_the_bounds(spark, monkeypatch):
    docs, queries = frames(spark)
    monkeypatch.setattr(lexical, "SCAN_MAX_WEIGHTS", 1)
    assert found(lexical.bm25_search(queries, lexical.index_of(docs, "doc_id", "text"), 3)) == brute_bm25(DOCS, QUERIES, 3)
    monkeypatch.setattr(lexical, "fits_broadcast", lambda df: False)
    assert found(lexical.bm25_search(queries, lexical.index_of(docs, "doc_id", "text"), 3)) == brute_bm25(DOCS, QUERIES, 3)


def test_many_weights_are_scanned_for_in_groups_of_queries(spark, monkeypatch):
    """Weights beyond a broadcast join, and beyond one scan, still shuffle no row per query and posting."""
    def refused(*_):
        raise AssertionError("joined")

    want = brute_bm25(DOCS, QUERIES, 4)
    monkeypatch.setattr(lexical, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(lexical, "_join_scores", refused)
    for most, terms in ((2_000_000, 1), (5, 3)):
        monkeypatch.setattr(lexical, "SCAN_MAX_WEIGHTS", most)
        monkeypatch.setattr(lexical, "_SLICE_TERMS", terms)
        docs, queries = frames(spark)
        got = lexical.bm25_search(queries, lexical.index_of(docs, "doc_id", "text"), 4)
        assert sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in got.collect()) == want


def test_a_search_without_stored_index_counts_only_the_wanted_terms(spark, monkeypatch):
    docs, queries = frames(spark)
    index = lexical.index_of(docs, "doc_id", "text")
    uncounted = index.forward.select("doc_id", F.raise_error(F.lit("all terms were counted")).cast("int").alias("dl"), "counts")
    got = lexical.bm25_search(queries, replace(index, forward=uncounted), 4)
    assert found(got) == brute_bm25(DOCS, QUERIES, 4)


def test_small_score_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "_BLOCK_VALUES", 1)
    corpus = random_corpus(2)
    docs, queries = frames(spark, *corpus)
    assert found(lexical.bm25_search(queries, lexical.index_of(docs, "doc_id", "text"), 5)) == brute_bm25(*corpus, k=5)


def test_search_without_match_or_queries(spark):
    docs, queries = frames(spark, queries=[(1, "nothing here")])
    index = lexical.index_of(docs, "doc_id", "text")
    assert lexical.bm25_search(queries, index).count() == 0
    assert lexical.bm25_search(queries.limit(0), index).count() == 0


def test_empty_corpus(spark):
    docs, queries = frames(spark, docs=[(1, "")])
    assert lexical.bm25_search(queries, lexical.index_of(docs, "doc_id", "text")).count() == 0


def test_string_ids(spark):
    docs, queries = frames(spark)
    index = lexical.index_of(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), "doc_id", "text")
    got = lexical.bm25_search(queries, index, 3)
    assert sorted((r.query_id, r["rank"], int(r.doc_id[1:]), round(r.score, 6)) for r in got.collect()) == brute_bm25(DOCS, QUERIES, 3)


def test_merge_keeps_first_query(spark, rows):
    hits = spark.createDataFrame(
        [(2, 1, "a", 9.0), (1, 2, "a", 1.0), (1, 1, "b", 2.0), (3, 1, "b", 5.0)], "query_id int, rank int, id string, score double"
    )
    assert rows(lexical.merge_hits(hits, ["id"]), "id", "query_id", "score") == [("a", 1, 1.0), ("b", 1, 2.0)]


def levenshtein(s, t, swap=False):
    rows = [[i + j if i * j == 0 else 0 for j in range(len(t) + 1)] for i in range(len(s) + 1)]
    for i in range(1, len(s) + 1):
        for j in range(1, len(t) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (s[i - 1] != t[j - 1]))
            if swap and i > 1 and j > 1 and s[i - 1] == t[j - 2] and s[i - 2] == t[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def mutated(rng, word):
    word = list(word)
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(word)) if word else 0
        kind = rng.choice("dist")
        if kind == "d" and word:
            del word[i]
        elif kind == "i":
            word.insert(i, rng.choice("abé"))
        elif kind == "s" and word:
            word[i] = rng.choice("abé")
        elif kind == "t" and i + 1 < len(word):
            word[i], word[i + 1] = word[i + 1], word[i]
    return "".join(word)


@pytest.mark.parametrize("swap", [False, True])
def test_fuzzy_expansion_equals_brute_force(spark, swap):
    rng = random.Random(7)
    wanted = {"".join(rng.choices("abé", k=n)) for n in (1, 2, 3, 4, 5, 6, 7, 9, 15, 16, 17, 18, 20, 25, 30) for _ in range(4)}
    vocabulary = {mutated(rng, w) for w in wanted for _ in range(25)} | {""}
    limit = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    want = {
        (w, v, levenshtein(w, v, swap)) for w in wanted for v in vocabulary if levenshtein(w, v, swap) <= limit(w)
    }
    got = lexical.expand_terms(
        spark.createDataFrame([(w,) for w in wanted], "term string"),
        spark.createDataFrame([(v,) for v in vocabulary], "term string"), swap,
    )
    found = [(r.term, r.match, r.edits) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == want
    assert all(abs(r.weight - (1 - r.edits / min(len(r.term), len(r.match)))) < 1e-12 for r in got.collect())


def test_fuzzy_search_finds_misspelt(spark):
    docs, queries = frames(spark, queries=[(1, "brid")])
    index = lexical.index_of(docs, "doc_id", "text")
    assert lexical.bm25_search(queries, index).count() == 0
    assert [r.doc_id for r in lexical.bm25_search(queries, index, fuzzy=True, transpositions=True).collect()] == [5]


def test_one_collection_is_read_and_a_change_may_move_or_empty_partitions(spark, tmp_path):
    path = str(tmp_path / "index")
    docs, queries = frames(spark)
    docs = docs.selectExpr("*", "CASE WHEN doc_id IN (3, 6, 7) THEN '01' ELSE '1' END AS base")
    index = lexical.write_index(docs, "doc_id", "text", path, keep=("base",), partition_by=("base",), buckets=2)
    hits = lexical.bm25_search(queries, index, 3, where=F.col("base") == "01")
    assert found(hits) == brute_bm25([d for d in DOCS if d[0] in (3, 6, 7)], QUERIES, 3)
    scan = index.postings.filter("base = '01'")
    plan = scan._sc._jvm.PythonSQLUtils.explainString(scan._jdf.queryExecution(), "formatted")
    assert "base" in next(line for line in plan.splitlines() if "PartitionFilters" in line)
    # A document moves to the other part; the rest of its old part is removed in the same write.
    moved = docs.filter("doc_id = 3").withColumn("base", F.lit("1"))
    for _ in range(2):
        index = lexical.write_index(moved, "doc_id", "text", path, mode="upsert", keep=("base",), remove=spark.createDataFrame([(6,), (7,)], "doc_id long"))
        assert {(r.doc_id, r.base) for r in index.forward.collect()} == {(d, "1") for d, _ in DOCS if d not in (6, 7)}
        assert index.postings.filter("base = '01'").count() == 0
        assert found(lexical.bm25_search(queries, index, 3)) == brute_bm25([d for d in DOCS if d[0] not in (6, 7)], QUERIES, 3)
    with pytest.raises(ValueError):
        lexical.write_index(docs, "doc_id", "text", path, partition_by=("base",))


def test_a_change_that_broke_off_is_made_whole_by_repeating_it(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    docs, queries = frames(spark)
    lexical.write_index(docs.filter("doc_id <= 3"), "doc_id", "text", path)
    monkeypatch.setattr(lexical, "_TABLES", ("postings", "terms"))  # broken off before sizes and forward
    with pytest.raises(KeyError):
        lexical.write_index(docs, "doc_id", "text", path, mode="append")
    monkeypatch.undo()
    index = lexical.write_index(docs, "doc_id", "text", path, mode="append")
    assert found(lexical.bm25_search(queries, index, 3)) == brute_bm25(DOCS, QUERIES, 3)


def test_posting_files_are_sorted_by_term(spark, tmp_path):
    """Also with more folders in a task than it keeps open; the setting is put back."""
    docs, _ = frames(spark, *random_corpus())
    before = spark.conf.get(lexical._OPEN_FILES)
    lexical.write_index(docs, "doc_id", "text", str(tmp_path / "index"))
    assert spark.conf.get(lexical._OPEN_FILES) == before
    files = list((tmp_path / "index" / "postings").rglob("*.parquet"))
    assert len({f.parent.name for f in files}) == lexical.BUCKETS
    for file in files:
        terms = pq.read_table(file).column("term").to_pylist()
        assert terms == sorted(terms)


def _files(path):
    return {f for f in path.rglob("*.parquet") if f.parent.name.startswith("bucket=")}


def test_new_documents_leave_stored_files_alone(spark, tmp_path):
    docs, queries = frames(spark)
    lexical.write_index(docs.filter("doc_id <= 3"), "doc_id", "text", str(tmp_path / "index"))
    before = _files(tmp_path / "index")
    for mode in ("append", "upsert"):
        index = lexical.write_index(docs.filter("doc_id > 3"), "doc_id", "text", str(tmp_path / "index"), mode=mode)
        assert before < _files(tmp_path / "index")
        assert found(lexical.bm25_search(queries, index, 3)) == brute_bm25(DOCS, QUERIES, 3)


def test_a_change_sent_again_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    docs, _ = frames(spark, *random_corpus())
    lexical.write_index(docs, "doc_id", "text", path)
    changed = docs.filter("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" more")))
    files = set()
    for _ in range(2):
        lexical.write_index(docs, "doc_id", "text", path, mode="append")
        lexical.write_index(changed, "doc_id", "text", path, mode="upsert")
        lexical.delete_from_index(docs.filter("doc_id % 5 = 0").select("doc_id"), path, "doc_id")
        docs, changed = docs.filter("doc_id % 5 != 0"), changed.filter("doc_id % 5 != 0")
        files, last = _files(tmp_path / "index"), files
    assert files == last


@pytest.mark.parametrize("few", [True, False])
def test_many_writes_are_put_together(spark, tmp_path, monkeypatch, few):
    """Null folders, moved and removed documents over more writes than are kept apart; postings stay sorted, by scan and by join."""
    monkeypatch.setattr(lexical, "MAX_WRITES", 2)
    monkeypatch.setattr(lexical, "fits_broadcast", lambda df: few)
    path = str(tmp_path / "index")
    corpus, asked = random_corpus(3, 60)
    docs, queries = frames(spark, corpus, asked)
    docs = docs.withColumn("base", F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 3).cast("string")))
    lexical.write_index(docs.filter("doc_id < 20"), "doc_id", "text", path, keep=("base",), partition_by=("base",), buckets=2)
    left = dict(corpus[:20])
    for step in range(5):
        lexical.write_index(docs.filter(f"doc_id < {30 + 5 * step}"), "doc_id", "text", path, mode="append", keep=("base",))
        moved = docs.filter(f"doc_id % 7 = {step}").withColumn("text", F.concat("text", F.lit(" w1 new"))).withColumn("base", F.lit("1"))
        lexical.write_index(moved, "doc_id", "text", path, mode="upsert", keep=("base",))
        left = dict(corpus[:30 + 5 * step]) | left | {i: t + " w1 new" for i, t in corpus if i % 7 == step}
        left.pop(40 + step, None)
        index = lexical.delete_from_index(spark.createDataFrame([(40 + step,)], "doc_id long"), path, "doc_id")
    assert sorted(r.doc_id for r in index.forward.collect()) == sorted(left)
    now = sorted(left.items())
    for share in (0.0, 1e9):
        monkeypatch.setattr(lexical, "SELECTIVE_SHARE", share)
        assert found(lexical.bm25_search(queries, index, 3)) == brute_bm25(now, asked, 3)
    assert len({f.parent.name for f in _files(tmp_path / "index" / "forward")}) <= 2 * (2 + 1)
    for file in (tmp_path / "index" / "postings").rglob("*.parquet"):
        terms = [t for t in pq.ParquetFile(file).read().column("term").to_pylist() if t is not None]
        assert terms == sorted(terms)
