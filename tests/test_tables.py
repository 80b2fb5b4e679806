import pytest
from pyspark.sql import functions as F

from docquarry.operators import maintenance, reports, validate
from docquarry.schemas import CHUNK
from docquarry.session import materialise
from docquarry.sources import chunks as store
from docquarry.sources import registry


def chunk_rows(spark, items):
    df = spark.createDataFrame(items, "collection string, partition_name string, chunk_id long, content string")
    return df.withColumn("ingest_date", F.lit("20240101"))


COLUMNS = ("collection", "partition_name", "chunk_id", "content")


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "chunks")
    store.write_chunks(chunk_rows(spark, [("c1", "p/1", 1, "a"), ("c1", "p/1", 2, "b"), ("c1", "p2", 3, "c"), ("c2", "p1", 4, "d")]), path)
    return path


def test_scan_prunes_partitions(spark, table, rows):
    got = store.scan_index(spark, table, "c1", "p/1")
    assert rows(got, *COLUMNS) == [("c1", "p/1", 1, "a"), ("c1", "p/1", 2, "b")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan
    assert got.schema.names == CHUNK.names or set(got.schema.names) == set(CHUNK.names)


def test_append_and_overwrite_of_one_partition(spark, table, rows):
    store.write_chunks(chunk_rows(spark, [("c1", "p2", 5, "e")]), table)
    assert store.scan_index(spark, table).count() == 5
    store.write_chunks(chunk_rows(spark, [("c1", "p2", 6, "f")]), table, "overwrite")
    assert rows(store.scan_index(spark, table), *COLUMNS) == [
        ("c1", "p/1", 1, "a"), ("c1", "p/1", 2, "b"), ("c1", "p2", 6, "f"), ("c2", "p1", 4, "d")
    ]
    with pytest.raises(ValueError):
        store.write_chunks(chunk_rows(spark, []), table, "replace")


def test_upsert_is_idempotent_and_local(spark, table, rows):
    sent = chunk_rows(spark, [("c1", "p/1", 2, "B"), ("c1", "p/1", 9, "n"), ("c3", "p1", 7, "new")])
    for _ in range(2):
        store.upsert_chunks(sent, table)
        assert rows(store.scan_index(spark, table), *COLUMNS) == [
            ("c1", "p/1", 1, "a"), ("c1", "p/1", 2, "B"), ("c1", "p/1", 9, "n"), ("c1", "p2", 3, "c"),
            ("c2", "p1", 4, "d"), ("c3", "p1", 7, "new"),
        ]


def test_delete_leaves_rest_and_empties_partitions(spark, table, rows):
    ids = spark.createDataFrame([(1,), (4,), (999,), (1,)], "chunk_id long")
    for _ in range(2):
        store.delete_chunks(ids, table)
        assert rows(store.scan_index(spark, table), *COLUMNS) == [("c1", "p/1", 2, "b"), ("c1", "p2", 3, "c")]


def test_changes_of_many_rows_leave_contents_where_they_are(spark, tmp_path, rows, monkeypatch):
    """Several files with more rows than a bitmap covers, and a folder of null that no change names."""
    staged, path = [], str(tmp_path / "chunks")
    monkeypatch.setattr(store, "materialise", lambda df, *rest: staged.append(df.columns) or materialise(df, *rest))
    wide = lambda a, b: spark.range(a, b, 1, 2).select(
        F.lit("c").alias("collection"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("p"), F.col("id") % 2)).alias("partition_name"),
        F.col("id").alias("chunk_id"), (F.col("id") % 100).alias("file_id"), F.col("id").cast("string").alias("content"),
    )
    store.write_chunks(wide(0, 100_000), path)
    store.write_chunks(wide(100_000, 110_000), path)
    held = {r.chunk_id: (r.partition_name, r.content) for r in wide(0, 110_000).collect()}
    found = lambda: {r.chunk_id: (r.partition_name, r.content) for r in store.scan_index(spark, path).collect()}

    sent = wide(50, 120_000).filter("partition_name = 'p1' and chunk_id % 3 = 0").withColumn("content", F.lit("new"))
    store.upsert_chunks(sent, path)
    held |= {i: ("p1", "new") for i in range(50, 120_000) if i % 7 and i % 2 and i % 3 == 0}
    assert found() == held
    store.delete_chunks(spark.range(0, 200_000).filter("id % 5 = 0 and id % 7 > 0").withColumnRenamed("id", "chunk_id"), path)
    held = {i: x for i, x in held.items() if i % 5 or i % 7 == 0}
    assert found() == held
    store.replace_files(wide(1, 90).filter("chunk_id % 7 != 0").limit(30), path)
    files = {(r.partition_name, r.file_id): r for r in wide(1, 90).filter("chunk_id % 7 != 0").limit(30).collect()}
    held = {i: x for i, x in held.items() if (x[0], i % 100) not in files} | {r.chunk_id: (p, r.content) for (p, _), r in files.items()}
    assert found() == held
    assert staged and not any("content" in columns for columns in staged)


def test_drop_and_ensure(spark, table, tmp_path, rows):
    assert store.drop_partition(spark, table, "c1", "p/1")
    assert not store.drop_partition(spark, table, "c1", "p/1")
    assert store.drop_collection(spark, table, "c2")
    assert rows(store.scan_index(spark, table), "chunk_id") == [(3,)]
    path = str(tmp_path / "new")
    store.ensure_collection(spark, path)
    store.ensure_collection(spark, path)
    assert store.scan_index(spark, path).count() == 0
    store.ensure_collection(spark, table)
    assert store.scan_index(spark, table).count() == 1


def test_registry(spark, tmp_path, rows):
    root = str(tmp_path / "registry")
    registry.init_registry(spark, root, default_user="owner")
    assert rows(registry.read_registry(spark, root, "user"), "user_id", "user_name", "user_status") == [(1, "owner", 1)]
    base = lambda i, u: (i, "knowledge_name_" + str(u), "handbook", 1, u)
    new = spark.createDataFrame(
        [base(1, 1), base(2, 2), base(3, 1)], "knowledge_id long, knowledge_name string, partition_name string, knowledge_status int, user_id long"
    )
    # Two users may share a name, one user may not repeat it.
    assert registry.add_absent(new, root, "knowledge", ["user_id", "partition_name"]) == 2
    assert registry.add_absent(new, root, "knowledge", ["user_id", "partition_name"]) == 0
    registry.init_registry(spark, root)
    assert registry.read_registry(spark, root, "knowledge").count() == 2
    registry.append_registry(new, root, "knowledge")
    assert registry.read_registry(spark, root, "knowledge").count() == 5
    registry.init_registry(spark, root, "overwrite")
    assert registry.read_registry(spark, root, "knowledge").count() == 0
    with pytest.raises(ValueError):
        registry.table_path(root, "other")


def test_maintenance(spark, rows):
    old = spark.createDataFrame([(1, 5, "a"), (2, 1, "b")], "id int, v int, s string")
    new = spark.createDataFrame([(2, 0, "x"), (2, 1, "y"), (3, 1, "z")], "id int, v int, s string")
    assert rows(maintenance.upsert(old, new, ["id"], ["v"])) == [(1, 5, "a"), (2, 1, "y"), (3, 1, "z")]
    assert rows(maintenance.upsert_report(old, new, ["id"])) == [(3, 2, 1, 1)]
    assert rows(maintenance.upsert_report(old, new.limit(0), ["id"])) == [(0, 0, 0, 0)]
    assert rows(maintenance.delete_by_ids(old, spark.createDataFrame([(2,), (8,)], "id int"), "id")) == [(1, 5, "a")]
    assert rows(maintenance.insert_if_absent(old, new, ["id"], ["v"])) == [(3, 1, "z")]
    assert rows(maintenance.present(old, new, ["id"])) == [(2, 1, "b")]
    assert maintenance.has_index(spark.createDataFrame([("KB",)], "collection string"), "collection", "kb")
    assert not maintenance.has_index(spark.createDataFrame([("KB",)], "collection string"), "collection", "k")
    many = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 99)], "file_id int, chunk_id int")
    assert rows(maintenance.by_file(many, [1], page=10), "chunk_id") == [(i,) for i in range(10)]
    assert maintenance.by_file(many, [1]).count() == many.filter("file_id = 1").count()


def test_uploads_pair_by_key(spark, rows):
    frame = lambda items, name: spark.createDataFrame(items, f"file_key int, {name} string")
    done, failed = maintenance.align_uploads(
        frame([(1, "a"), (2, "b"), (3, "c")], "file_name"), frame([(3, "u3"), (1, "u1")], "file_url"), frame([(1, "p1"), (2, "p2"), (3, "p3")], "file_path")
    )
    assert rows(done) == [(1, "a", "u1", "p1"), (3, "c", "u3", "p3")]
    assert rows(failed, "file_key") == [(2,)]


def test_uploads_of_a_large_table_are_dealt_to_more_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(maintenance, "TASK_ROWS", 10, raising=False)
    keys = spark.range(200).select(F.col("id").alias("file_key"))
    side = lambda name, step: keys.filter(F.col("file_key") % step == 0).withColumn(name, F.lit(name))
    done, failed = maintenance.align_uploads(side("file_name", 1), side("file_url", 2), side("file_path", 3))
    assert [k for k, *_ in rows(done)] == list(range(0, 200, 6)) and failed.count() == 166
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3 and "], 20" in plan


def test_validation(spark):
    users = spark.createDataFrame(
        [(1, "abc", 1), (1, "ab", 1), (1, "x" * 21, 1), (1, "abcd", 2), (0, "abcd", 0), (1, None, 1), (None, "abcd", 1)],
        "user_id int, user_name string, user_status int",
    )
    codes = [r.error_code for r in validate.validate_users(users).collect()]
    assert codes == ["ok", "name_length", "name_length", "status_value", "id_not_positive", "name_length", "id_not_positive"]
    good, bad = validate.split_valid(validate.validate_users(users))
    assert (good.count(), bad.count()) == (1, 6)
    texts = spark.createDataFrame([("a" * 5, "b"), ("a", "b" * 5), ("a" * 5, "b" * 5), (None, "b")], "x string, y string")
    checked = validate.validate_lengths(texts, {"x": 4, "y": 4})
    assert [r.error_code for r in checked.collect()] == ["x_too_long", "y_too_long", "x_too_long", "ok"]
    report = reports.ingest_report(checked.withColumn("file_id", F.lit(1))).first()
    assert (report.written, report.errors) == (1, 3)


def test_registry_over_jdbc(spark):
    """The driver's own Derby, in memory: written, appended, read back in partitions."""
    from docquarry.sources.files import read_jdbc, write_jdbc

    url = "jdbc:derby:memory:registry;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    users = spark.createDataFrame([(i, f"user{i}", i % 2) for i in range(20)], "user_id long, user_name string, user_status int")
    write_jdbc(users.filter("user_id < 15"), url, "registry_user", "overwrite", **options)
    write_jdbc(users.filter("user_id >= 15"), url, "registry_user", **options)
    bounds = {"partitionColumn": "user_id", "lowerBound": "0", "upperBound": "20", "numPartitions": "4"}
    back = read_jdbc(spark, url, "registry_user", **options, **bounds)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in users.collect())


def test_catalog_table(spark, tmp_path, rows):
    from docquarry.sources.tables import create_table, drop_partitions, drop_table, insert_chunks, list_partitions, table_exists

    chunks = spark.createDataFrame(
        [("a b", "x/1", 1, "one"), ("a b", "p+q", 2, "two"), ("it's", "100%", 3, "three"), ("c", "x", 4, "four")],
        "collection string, partition_name string, chunk_id long, content string",
    )
    create_table(spark, "chunk_table", str(tmp_path / "chunks"))
    create_table(spark, "chunk_table")
    assert list_partitions(spark, "chunk_table").count() == 0
    insert_chunks(chunks, "chunk_table")
    assert rows(list_partitions(spark, "chunk_table")) == [("a b", "p+q"), ("a b", "x/1"), ("c", "x"), ("it's", "100%")]
    insert_chunks(chunks.filter("chunk_id = 4").withColumn("content", F.lit("new")), "chunk_table", overwrite=True)
    assert rows(spark.table("chunk_table"), "content") == [("new",), ("one",), ("three",), ("two",)]
    assert drop_partitions(spark, "chunk_table", "a b", "p+q") == 1 and drop_partitions(spark, "chunk_table", "it's") == 1
    assert drop_partitions(spark, "chunk_table", "unknown") == 0
    assert rows(list_partitions(spark, "chunk_table")) == [("a b", "x/1"), ("c", "x")]
    assert rows(spark.table("chunk_table"), "content") == [("new",), ("one",)]
    drop_table(spark, "chunk_table")
    assert not table_exists(spark, "chunk_table")


def test_new_files_leave_what_is_stored_alone(spark, tmp_path):
    """Chunks of files the table does not hold are added; the stored files of the same partition are not written again."""
    path = str(tmp_path / "chunks")

    def rows(*files):
        values = [("c", "p", f, 10 * f + i, f"text {f} {i}") for f in files for i in range(2)]
        return spark.createDataFrame(values, "collection string, partition_name string, file_id long, chunk_id long, content string")

    def stored():
        return {f.name for f in (tmp_path / "chunks").rglob("*.parquet")}

    store.replace_files(rows(1, 2), path)
    before = stored()
    store.replace_files(rows(3), path)
    assert before < stored()
    store.replace_files(rows(3), path)
    held = store.scan_index(spark, path).groupBy("file_id").count().collect()
    assert sorted((r.file_id, r["count"]) for r in held) == [(1, 2), (2, 2), (3, 2)]
