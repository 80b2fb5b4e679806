import hashlib
import math

import pyarrow as pa
from pyspark.sql import functions as F

from docquarry.functions import geometry, keys, names, text, vectors
from docquarry.operators import embedding


def one(spark, expression, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expression.alias("v")).first()["v"]


def test_clean_file_name(spark):
    cases = {
        "a%20b.txt": "a b.txt",
        "a+b.txt": "a+b.txt",
        "broken%zz.txt": "broken%zz.txt",
        "x/y！z　.md": "x_yz.md",
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    for raw, want, got in df.select("raw", "want", names.clean_file_name("raw")).collect():
        assert got == want, raw


def test_truncated_names_fit_keep_extension_and_differ(spark):
    raw = ["n" * 46 + ".txt", "n" * 47 + ".txt", "n" * 200 + "1.txt", "n" * 200 + "2.txt", "." + "e" * 80, "a." + "e" * 80]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    got = [r[0] for r in df.select(names.truncate_name("raw")).collect()]
    assert got[0] == raw[0]
    assert all(len(g) <= 50 for g in got)
    assert all(g.endswith(".txt") for g in got[1:4])
    assert len(set(got)) == len(got)


def test_small_name_functions(spark):
    assert one(spark, names.collection_name("u"), u=8) == "knowledge_name_8"
    assert one(spark, names.object_path("u", F.lit("f.txt")), u=1) == "documents-1/f.txt"
    assert one(spark, names.stem("p"), p="a/b/c.tar.gz") == "c"
    assert one(spark, names.media_type("p"), p="a/B.PDF") == "application/pdf"
    assert one(spark, names.media_type("p"), p="a/none") is None
    assert one(spark, names.escape_spaces("p"), p="a b c") == "a%20b%20c"
    assert one(spark, names.index_name("p"), p="KB") == "kb"


def test_transliterate_only_rows_with_han(spark, rows):
    mapping = spark.createDataFrame([("你", "ni"), ("好", "hao")], "character string, reading string")
    df = spark.createDataFrame([(1, "你好,x"), (2, "plain"), (3, "世"), (4, None)], "id int, name string")
    got = dict(names.transliterate(df, "name", mapping).collect())
    assert got == {1: "nihao,x", 2: "plain", 3: "世", 4: None}
    twice = spark.createDataFrame([("一", "yi"), ("丁", "ding"), ("一", "Yi"), ("七", "qi")], "character string, reading string")
    assert dict(names.transliterate(spark.createDataFrame([(1, "一丁七")], "id int, name string"), "name", twice).collect()) == {1: "Yidingqi"}


def test_tokens_and_counts(spark):
    assert one(spark, text.tokenize("t"), t="Été, the THE-end 42!") == ["été", "the", "the", "end", "42"]
    counts = one(spark, text.term_counts(text.tokenize("t")), t="b a b, c b a")
    assert [(c.term, c.tf) for c in counts] == [("a", 2), ("b", 3), ("c", 1)]
    assert one(spark, text.term_counts(text.tokenize("t")), t="...") == []
    assert one(spark, text.tokenize("t", han_bigrams=True), t="abc知识库1 库") == ["abc", "知识", "识库", "1", "库"]
    assert one(spark, text.whitespace_tokens("t"), t="  a b\n c ") == 3


def test_prompts(spark):
    default = "Given a web search query, retrieve relevant passages that answer the query"
    for given in (None, ""):
        got = one(spark, text.rerank_prompt("q", "d", F.lit(given).cast("string")), q="Q", d="D")
        assert got == f"<Instruct>: {default}\n<Query>: Q\n<Document>: D"
    assert one(spark, text.query_prompt("q", F.lit("I")), q="Q") == "Instruct: I\nQuery: Q"
    assert one(spark, text.query_prompt("q", F.lit(None).cast("string")), q="Q") == "Q"


def test_token_overlap(spark):
    assert one(spark, text.token_overlap("a", "b"), a="x y z", b="y z w") == 0.5
    assert one(spark, text.token_overlap("a", "b"), a="", b="") == 0.0


def test_vectors(spark):
    v = F.array(*[F.lit(x) for x in (3.0, 4.0)])
    zero = F.array(F.lit(0.0), F.lit(0.0))
    get = lambda e: spark.range(1).select(e.alias("v")).first()["v"]
    assert get(vectors.l2_normalize(v)) == [0.6, 0.8]
    assert get(vectors.l2_normalize(zero)) == [0.0, 0.0]
    assert get(vectors.cosine(v, zero)) == 0.0
    assert get(vectors.l2_distance(v, zero)) == 5.0
    assert get(vectors.inner_product(v, v)) == 25.0
    floats = v.cast("array<float>")
    assert get(vectors.cut_dimensions(floats, 1)) == [3.0]
    assert get(vectors.cut_dimensions(floats, 5)) == [3.0, 4.0]
    assert get(vectors.fit_dimensions(floats, 1)) == [3.0]
    assert get(vectors.fit_dimensions(floats, 2)) == [3.0, 4.0]
    assert get(vectors.fit_dimensions(floats, 4)) == [3.0, 4.0, 0.0, 0.0]
    for unchanged in (0, None):
        assert get(vectors.fit_dimensions(floats, unchanged)) == [3.0, 4.0]
    assert math.isclose(get(vectors.yes_probability(F.lit(0.0), F.lit(0.0))), 0.5)


def test_corners(spark):
    def corners(points):
        df = spark.createDataFrame([(points,)], "points array<struct<x:double,y:double>>")
        return [tuple(p) for p in df.select(geometry.order_corners("points")).first()[0]]

    assert corners([(9.0, 9.0), (0.0, 0.0), (9.0, 0.0), (0.0, 9.0)]) == [(0, 0), (9, 0), (9, 9), (0, 9)]
    # A turned square: sums tie in pairs and the other two corners tie in y-x; the earlier one is taken each time.
    assert corners([(5.0, 0.0), (10.0, 5.0), (5.0, 10.0), (0.0, 5.0)]) == [(5, 0), (5, 10), (10, 5), (5, 10)]


def test_clip_truncates(spark):
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-5.0, 3.9), (1e3, 1e3), (1.5, 2.5), (0.0, 0.0))])
    got = spark.range(1).select(geometry.clip_points(points, 100, 50)).first()[0]
    assert [tuple(p) for p in got] == [(0, 3), (99, 49), (1, 2), (0, 0)]


def test_keys_are_stable(spark):
    df = spark.createDataFrame([("c", "p", 1, i) for i in range(1000)], "c string, p string, f long, i int")
    keyed = df.select(keys.chunk_key("c", "p", "f", "i").alias("k"))
    assert keyed.distinct().count() == 1000
    assert keyed.subtract(df.repartition(7).select(keys.chunk_key("c", "p", "f", "i"))).count() == 0


def test_lists_are_cut_into_bounded_slices():
    lists = pa.array([["b", "a", "b"], None, [], ["ü", "a"], ["z"] * 3])
    assert [list(range(5))[part] for part in text.list_slices(lists, 4)] == [[0, 1, 2], [3], [4]]


def test_hashed_tokens_of_a_task_are_remembered_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(embedding, "KNOWN_TOKENS", 2)
    known = {}
    got = embedding._bucket_counts(pa.array([["a", "b", "c", "a"], None, ["b"]]), 8, False, known)
    bucket = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 8
    want = [[sum(bucket(t) == b for t in tokens) for b in range(8)] for tokens in (["a", "b", "c", "a"], [], ["b"])]
    assert got.tolist() == want and len(known) <= 2


def test_terms_counted_in_arrow_equal_those_counted_in_the_row(spark, monkeypatch):
    from docquarry.functions import text

    monkeypatch.setattr(text, "SLICE_TOKENS", 5)
    rows = [(1, ["b", "a", "b"]), (2, []), (3, ["é", "z", "東", "z", "𐐷", "ﬀ"]), (4, ["a"] * 12), (5, [])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>").coalesce(1)
    got = df.select("id", text.counted_terms()(F.col("tokens")).alias("a"), text.term_counts(F.col("tokens")).alias("b")).collect()
    assert len(got) == 5 and all(r.a == r.b for r in got)
