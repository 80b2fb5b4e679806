import json
import os
import time
import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docquarry import session
from docquarry.functions import payload
from docquarry.operators import blocks, lexical
from docquarry.operators.chunking import chunk_fixed
from docquarry.operators.steps import run_steps, run_values
from docquarry.plans.ingest import Store, ingest, load_text_index
from docquarry.operators.lexical import bm25_search
from docquarry.sources.chunks import scan_index
from docquarry.sources.files import file_manifest, read_documents
from docquarry.sources.registry import read_registry
from docquarry.streaming import ingest as streaming


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a b.txt").write_text("first line about foxes\n\n" + "filler words here " * 20, encoding="utf-8")
    (root / "sub" / "c.txt").write_text("zweite Datei über Füchse", encoding="utf-8")
    return root


def test_files(spark, folder):
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in read_documents(spark, str(folder)).collect()}
    assert texts["c.txt"] == "zweite Datei über Füchse" and len(texts) == 2
    manifest = {r.file_name: r for r in file_manifest(spark, str(folder)).collect()}
    assert set(manifest) == {"a b.txt", "c.txt"}
    assert manifest["c.txt"].n_bytes == len("zweite Datei über Füchse".encode())
    assert manifest["c.txt"].media_type == "text/plain"
    assert "content" not in file_manifest(spark, str(folder)).columns
    assert "content" in file_manifest(spark, str(folder), with_content=True).columns


def test_ingest_all_files_and_search(spark, folder, tmp_path):
    store = Store(str(tmp_path / "store"))
    report = ingest(spark, str(folder), store, 7, " manual ", dimensions=16).collect()
    rows = scan_index(spark, store.chunks, "knowledge_name_7", "manual")
    # Every file of the batch survives.
    assert rows.select("file_id").distinct().count() == 2
    assert sum(r.written for r in report) == rows.count() and sum(r.errors for r in report) == 0
    assert rows.filter(F.length("content") > 100).count() == 0
    assert {len(r.embedding) for r in rows.collect()} == {16}
    assert {r.object_path for r in read_registry(spark, store.registry, "file").collect()} == {
        "documents-7/a b.txt", "documents-7/c.txt"
    }
    queries = spark.createDataFrame([(1, "füchse")], "query_id int, text string")
    hit = bm25_search(queries, load_text_index(spark, store)).first()
    assert rows.filter(F.col("chunk_id") == hit.chunk_id).first().file_name == "c.txt"
    # A repeated run changes nothing, in either mode.
    keys = sorted(r.chunk_id for r in rows.collect())
    for mode in ("append", "overwrite"):
        ingest(spark, str(folder), store, 7, "manual", mode=mode, dimensions=16)
        assert sorted(r.chunk_id for r in scan_index(spark, store.chunks).collect()) == keys
        assert sorted(r.chunk_id for r in load_text_index(spark, store).forward.collect()) == keys
    # A changed file replaces its chunks in both stores; other files and other bases stay.
    ingest(spark, str(folder), store, 8, "manual", dimensions=16)
    (folder / "a b.txt").write_text("only hedgehogs", encoding="utf-8")
    ingest(spark, str(folder), store, 7, "manual", dimensions=16)
    mine = scan_index(spark, store.chunks, "knowledge_name_7", "manual")
    assert {r.content for r in mine.collect()} == {"only hedgehogs", "zweite Datei über Füchse"}
    index = load_text_index(spark, store)
    foxes = spark.createDataFrame([(1, "foxes")], "query_id int, text string")
    own = F.col("collection") == "knowledge_name_7"
    assert bm25_search(foxes, index, where=own).count() == 0 and bm25_search(foxes, index).count() == 1
    # An empty batch changes nothing and says so.
    none = ingest(spark, spark.createDataFrame([], "path string, text string"), store, 7, "manual", dimensions=16).collect()
    assert [(r.file_id, r.written, r.errors) for r in none] == [(None, 0, 0)] and mine.count() == 2
    assert read_registry(spark, store.registry, "file").count() == 4
    assert read_registry(spark, store.registry, "knowledge").count() == 2


REQUESTS = [
    ("embeddings", '{"input": ["a", "b"], "model": "m"}', "ok"),
    ("embeddings", '{"input": "Hello World"}', "ok"),
    ("embeddings", '{"model": "m"}', "missing_input"),
    ("embeddings", '{"input": []}', "missing_input"),
    ("embeddings", '{"input": {"a": 1}}', "invalid_input"),
    ("embeddings", '{"input": 7}', "invalid_input"),
    ("rerank", '{"query": "q", "documents": ["a", "b"], "top_n": 1}', "ok"),
    ("rerank", '{"documents": ["a"]}', "missing_query"),
    ("rerank", '{"query": "", "documents": ["a"]}', "missing_query"),
    ("rerank", '{"query": "q"}', "invalid_documents"),
    ("rerank", '{"query": "q", "documents": "a"}', "invalid_documents"),
    ("rerank", '{"query": "q", "documents": []}', "invalid_documents"),
    ("embeddings", '{"input": "0"}', "ok"),
    ("embeddings", '{"input": "null"}', "ok"),
    ("embeddings", '{"input": ["[]"]}', "ok"),
    ("embeddings", '{"input": "[]"}', "ok"),
    ("embeddings", '{"input": 0}', "missing_input"),
    ("embeddings", '{"input": null}', "missing_input"),
    ("embeddings", '{"input": false}', "missing_input"),
    ("rerank", '{"query": "false", "documents": ["a"]}', "ok"),
    ("rerank", "invalid json", "invalid_json"),
    ("rerank", "[1]", "invalid_json"),
    ("embeddings", "{}", "missing_body"),
    ("embeddings", "", "missing_body"),
    ("embeddings", None, "missing_body"),
]


def test_request_codes(spark):
    df = spark.createDataFrame(REQUESTS, "endpoint string, body string, want string")
    for r in payload.classify_requests(df).collect():
        assert r.error_code == r.want, r.body
        assert (r.error is None) == (r.want == "ok")


def test_text_lists_and_usage(spark, rows):
    df = spark.createDataFrame([('"a"',), ('["a", "b c"]',), ("5",), (None,)], "raw string")
    assert [r[0] for r in df.select(payload.as_text_list("raw")).collect()] == [["a"], ["a", "b c"], None, None]
    usage = spark.createDataFrame([(1, "a b", "c"), (1, "d", None), (2, "", "")], "id int, q string, d string")
    assert rows(payload.token_usage(usage, "id", ["q", "d"])) == [(1, 4, 4), (2, 0, 0)]


@pytest.mark.parametrize("kind", ["float", "base64"])
def test_payload_round_trip(spark, kind):
    df = spark.createDataFrame([(1, [0.5, -1.25]), (2, [3.0, 1e-7])], "id int, embedding array<float>")
    body = payload.encode_embedding_payloads(df, "id", encoding_format=kind)
    element = json.loads(body.filter("id = 1").first().payload)
    assert element["object"] == "embedding" and element["index"] == 0
    wrapped = body.withColumn("payload", F.concat(F.lit('{"data":['), "payload", F.lit("]}")))
    got = {r.id: r.embedding for r in payload.decode_embedding_payloads(wrapped).filter("size_ok").collect()}
    assert got == {r.id: r.embedding for r in df.collect()}


def test_block_payload_with_shape(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<float>").select(F.base64(payload.pack_floats("v")).alias("b"))
    text = df.first().b
    bodies = [(1, json.dumps({"embeddings": text, "original_shape": "(2, 2)"})), (2, json.dumps({"embeddings": text, "original_shape": "(3, 2)"}))]
    got = payload.decode_embedding_payloads(spark.createDataFrame(bodies, "id int, payload string")).collect()
    assert [(r["index"], r.embedding) for r in got if r.id == 1] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    assert all(r.size_ok for r in got if r.id == 1) and not any(r.size_ok for r in got if r.id == 2)


def test_payloads_without_vectors_stay(spark):
    bodies = [(1, "{broken"), (2, '{"error": {"code": "x"}}'), (3, '{"data": []}'), (4, None), (5, '{"embeddings": "AAAAAA==", "original_shape": "(0, 4)"}')]
    got = payload.decode_embedding_payloads(spark.createDataFrame(bodies, "id int, payload string")).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5]
    assert all(r.embedding is None and r["index"] is None and not r.size_ok for r in got)


HTML = (
    "<html><head><title>T &amp; t</title><style>p{}</style><script>var a='</p>';</script></head><body><h2>Head</h2>"
    "<p>One <b>bold</b><br>two</p><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr></table>"
    "<img src='x.png'><pre>code</pre>tail<!-- no --></body></html>"
)


def test_page_blocks(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>unclosed")], "page_id int, html string")
    got = [(r.block_type, r.text) for r in blocks.extract_blocks(df).filter("page_id = 1").orderBy("block_pos").collect()]
    assert got == [
        ("title", "T & t"), ("heading2", "Head"), ("text", "One bold two"), ("list_item", "a"), ("list_item", "b"),
        ("table_row", "1 2"), ("image", "x.png"), ("code", "code"), ("text", "tail"),
    ]
    markdown = {r.page_id: r.markdown for r in blocks.to_markdown(df).collect()}
    assert markdown[1].split("\n\n")[:4] == ["# T & t", "## Head", "One bold two", "- a"]
    assert markdown[2] == "" and markdown[3] == "unclosed"
    routes = {r.page_id: r.route for r in blocks.route_pages(df, min_chars=10).collect()}
    assert routes == {1: "txt", 2: "ocr", 3: "ocr"}


def test_page_blocks_hold_a_slice_of_a_batch_as_objects(monkeypatch):
    monkeypatch.setattr(blocks, "SLICE_BYTES", 50_000)
    pages = [HTML + f"<p>page {i}</p>" * 20 for i in range(1_000)] + [None, ""]
    batch = pa.array(pages)
    tracemalloc.start()
    got = blocks.read_batch(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e6
    assert len(got) == len(pages) and got[-2:].to_pylist() == [[], []]
    assert got[432].as_py() == [{"block_type": t, "text": s} for t, s in blocks._BlockReader().read(pages[432])]


def test_steps(spark):
    df = spark.createDataFrame([("x" * 150, 0.9), ("y", 0.1)], "text string, score double")
    got = run_steps(df, [{"min_score": None}, {"chunk_fixed": {"size": 100, "overlap": 10}}])
    assert [len(r.content) for r in got.collect()] == [100, 60]
    with pytest.raises(ValueError):
        run_steps(df, [{"__import__": {}}])
    with pytest.raises(ValueError):
        run_steps(df, [{"min_score": {}, "chunk_fixed": {}}])


def test_stream_ingest_reads_each_file_once(spark, tmp_path, rows):
    source, target, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    write = lambda i: spark.createDataFrame([(i, "x" * 150)], "doc_id long, text string").write.mode("append").parquet(source)
    schema = "doc_id long, text string"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        streaming.ingest_stream(stream, chunk_fixed, target, state).awaitTermination()
        return rows(spark.read.parquet(target), "doc_id", "chunk_pos")

    write(1)
    assert run() == [(1, 0), (1, 1)]
    assert run() == [(1, 0), (1, 1)]
    write(2)
    assert run() == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_stream_windows_and_repeats(spark, tmp_path, rows):
    """Files arrive latest first, one per batch, and every file repeats rows of the one before."""
    source = str(tmp_path / "events")
    data = [(i, f"2024-01-0{1 + i // 10} 0{i % 3}:00:00", "view") for i in range(30)]
    for first in (20, 10, 0):
        df = spark.createDataFrame(data[first : first + 12], "event_id long, ts string, event_type string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    def stream():
        reader = spark.readStream.schema("event_id long, ts timestamp, event_type string")
        return reader.option("maxFilesPerTrigger", 1).parquet(source)

    columns = ["event_id", "event_type"]
    for _ in range(2):
        streaming.dedup_stream(stream(), ["event_id"], str(tmp_path / "once"), str(tmp_path / "s1"), columns).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "once")).collect()) == list(range(30))
    streaming.count_stream(stream(), "ts", ["event_type"], str(tmp_path / "w"), str(tmp_path / "s2")).awaitTermination()
    final = streaming.read_counts(spark, str(tmp_path / "w"), ["window_start", "event_type"])
    assert sum(r.n for r in final.collect()) == 34 and final.count() == 9


def test_repeats_in_state_and_late_rows_aside(spark, tmp_path):
    """Three batches out of order: keys in state are bounded by the delay, later rows are stored aside and merged."""
    source, target = str(tmp_path / "events"), str(tmp_path / "once")
    schema = "event_id long, ts timestamp, event_type string"

    def write(rows):
        df = spark.createDataFrame([(i, f"2024-01-{d:02d} 00:00:00", "view") for i, d in rows], "event_id long, ts string, event_type string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    write([(i, 1 + i // 100) for i in range(1000)])  # ten days
    write([(i, 10 + i // 100) for i in range(900, 1500)] + [(i, 1) for i in range(50)])  # repeats in time, and long after it
    write([(i, 2) for i in range(2000, 2100)] * 2 + [(1499, 24)])  # only late rows, twice, and a repeat
    write([(i, 25) for i in range(3000, 3003)])
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = streaming.dedup_stream(stream, ["event_id"], target, str(tmp_path / "s"), ["event_id", "event_type"], "ts", "2 days")
        query.awaitTermination(300)
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert not held or held[-1] < 700  # keys of ten days and more have left the state
    kept = streaming.read_first(spark, target, ["event_id"])
    assert sorted(r.event_id for r in kept.collect()) == [*range(1500), *range(2000, 2100), *range(3000, 3003)]
    assert spark.read.parquet(target).filter("late AND event_id >= 2000").count() >= 200


def test_broken_off_stream_fills_both_stores_once(spark, tmp_path, monkeypatch):
    from docquarry.streaming import stores

    source, root = str(tmp_path / "src"), str(tmp_path / "store")
    store = Store(root)
    schema = "path string, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stores.store_stream(stream, store, 7, "manual", str(tmp_path / "state"), dimensions=8).awaitTermination(300)

    arrive([("a.txt", "one fox"), ("b.txt", "two foxes " * 30)])
    whole = stores.index_files
    monkeypatch.setattr(stores, "index_files", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        run()
    written = sorted(r.chunk_id for r in scan_index(spark, store.chunks).collect())
    assert written
    monkeypatch.setattr(stores, "index_files", whole)
    replaced = []
    monkeypatch.setattr(stores, "replace_files", lambda *a: replaced.append(a))
    run()
    assert not replaced  # the chunk table had the batch
    monkeypatch.undo()
    arrive([("a.txt", "one hedgehog"), ("c.txt", "")])
    run()
    run()
    rows = scan_index(spark, store.chunks).collect()
    assert {r.content for r in rows if r.file_path == "a.txt"} == {"one hedgehog"}
    assert sorted(r.chunk_id for r in rows) == sorted(r.chunk_id for r in load_text_index(spark, store).forward.collect())
    assert {len(r.embedding) for r in rows} == {8}


def test_a_row_stops_where_a_step_yields_nothing(spark):
    rows = [(1, "<p>Long enough</p>"), (2, "<b>x</b>"), (3, None), (4, "<i>no 12345 here</i>")]
    df = spark.createDataFrame(rows, "id int, html string")
    got = {r.id: (r.value, r.stopped_at) for r in run_values(df, [
        {"strip_markup": None}, {"squeeze_space": {}}, {"at_least": {"n": 5}}, {"without": {"pattern": "[0-9]{5}"}}, {"extract": {"pattern": "[A-Z]\\w+"}},
    ], "html").collect()}
    assert got == {1: ("Long", None), 2: (None, "3 at_least"), 3: (None, "0 input"), 4: (None, "4 without")}
    with pytest.raises(ValueError):
        run_values(df, [{"eval": None}], "html")


@pytest.mark.parametrize("split", ["fixed", "recursive"])
def test_ingest_stores_a_chunk_once(spark, tmp_path, monkeypatch, split):
    """Staged chunks have no vectors and go before postings are written; postings name a document by its number."""
    from docquarry.operators.chunking import chunk_recursive
    from docquarry.plans import ingest as plan

    staged, at_postings = {}, []
    whole = plan.materialise
    monkeypatch.setattr(plan, "materialise", lambda df, purpose, **o: staged.setdefault(purpose, whole(df, purpose, **o)))
    stored = lexical._posted
    monkeypatch.setattr(lexical, "_posted", lambda *a: at_postings.append(os.path.exists(place)) or stored(*a))
    files = spark.createDataFrame([(f"{i}.txt", f"some words {i} " * 40) for i in range(30)] + [("x" * 700, "refused")], "path string, text string")
    place = ""

    def release(self, own=plan.Checked.release):
        nonlocal place
        place = staged["checked-chunks"].inputFiles()[0].removeprefix("file://")
        assert os.path.exists(place)
        own(self)

    monkeypatch.setattr(plan.Checked, "release", release)
    store = Store(str(tmp_path / "store"))
    report = ingest(spark, files, store, 1, "kb", dimensions=8, splitter=chunk_fixed if split == "fixed" else chunk_recursive)
    assert "embedding" not in staged["checked-chunks"].columns and at_postings == [False]
    rows = scan_index(spark, store.chunks)
    assert {len(r.embedding) for r in rows.collect()} == {8} and rows.select("file_id").distinct().count() == 30
    assert [r.errors for r in report.filter("errors > 0").collect()] == [1] and report.count() == 31
    refused = spark.read.parquet(store.quarantine)
    assert [(r.error_code, len(r.embedding)) for r in refused.collect()] == [("file_path_too_long", 8)]
    for file in (tmp_path / "store" / "text_index" / "postings").rglob("*.parquet"):
        assert pq.read_schema(file).names == ["doc", "term", "tf"]
    index = load_text_index(spark, store)
    assert {r.chunk_id for r in index.postings.collect()} == {r.chunk_id for r in rows.collect()}


def test_a_write_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for n in manager.getAllFiles().mkString(" ").split() if "/shuffle_" in n}
    before = shuffles()
    kept = session.materialise(spark.range(1000).repartition(3, "id"), "test-shuffle")
    assert len(kept.collect()) == 1000
    until = time.time() + 20
    while shuffles() - before and time.time() < until:  # they are deleted in the background
        time.sleep(0.2)
    assert not shuffles() - before


def test_arriving_files_of_finished_batches_are_deleted(spark, tmp_path, monkeypatch):
    from docquarry.catalog import streams

    monkeypatch.setattr(streams, "scratch_path", lambda spark, purpose: str(tmp_path / purpose))
    rows = [(f"d{i}", f"words of {i} " * 30) for i in range(60)]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = streams.stream_stores(spark, str(tmp_path)).collect()
    assert len(got) == 60 and all(r.chunks == r.embedded == r.indexed for r in got)
    cores = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "arriving").glob("*.parquet"))) <= 2 * cores
