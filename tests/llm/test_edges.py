"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import gzip
import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import bpe, decontaminate, host_quality, html_text, jaccard_join, secrets, sharding, warc
from docquarry.llm.backoff import backoff_scores
from docquarry.llm.queries import encoded_documents
from docquarry.llm.token_scan import document_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, m string, n_words int, kept string, id string, size string, row string, hits string"
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))


def frame(spark, texts):
    rows = [(i, t, None, None if (i or 0) % 3 == 0 else "s", None, "m", 1, "k", "i", "z", "r", "h") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (5, LONG), (None, "no id here"), (6, "one"), (7, "ONE\n")])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_host_quality(odd, none):
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in host_quality.host_quality(odd).collect()}
    assert (1, 0, True, False) in got and (2, 0, True, False) in got and (5, 60_000, False, False) in got
    assert host_quality.host_quality(odd).count() == 9
    assert host_quality.host_quality(none).count() == 0
    assert host_quality.keep_good(none).columns == none.columns and host_quality.keep_good(none).count() == 0
    assert host_quality.keep_good(odd).count() == 0


def test_decontaminate(spark, odd, none):
    items = benchmark(spark, [(1, " ".join(LONG.split()[1000:1040])), (2, None), (3, ""), (None, LONG[:300]), (1, " ".join(LONG.split()[1000:1040]))])
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, items).collect()} == {(5, 1)}
    assert decontaminate.contaminated(odd, benchmark(spark, [])).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0
    kept = decontaminate.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == 7


def test_warc(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (2, "http://x/ y", "", "b"), (3, "http://x", "<p>é&amp;" + "x " * 100_000, "c")], "page_id long, url string, html string, kind string")
    records = pages.select("page_id", warc.responses(F.col("url"), F.col("html")).alias("record"))
    got = warc.derivatives(records, keep=("page_id",)).collect()
    assert len(got) == 6 and {r.kind for r in got} == {"metadata", "conversion"}
    assert [r.block_length for r in got if r.page_id == 1 and r.kind == "conversion"] == [0]
    assert warc.derivatives(records.limit(0)).count() == 0
    bad = spark.createDataFrame([(bytearray(b"junk"),), (None,), (bytearray(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nx"),)], "record binary")
    assert [r.problem for r in warc.derivatives(bad).collect()] == ["no WARC version", "wrong length"]


def crawled(body, *http, version="WARC/1.1", date="2024-05-01T00:00:00Z"):
    head = "".join(f"{h}\r\n" for h in ("HTTP/1.1 200 OK", "Content-Type: text/html", *http)).encode()
    block = head + b"\r\n" + body
    lines = f"WARC-Type: response\r\nWARC-Record-ID: <urn:x:{len(block)}>\r\nWARC-Date: {date}\r\nContent-Length: {len(block)}\r\n"
    return f"{version}\r\n{lines}\r\n".encode() + block


def conversion(record):
    return {d[0]: warc.parse_record(d[8])[1].decode() for d in warc.derive(record)}


def test_warc_files_of_both_versions(spark, tmp_path):
    records = [crawled(f"<p>text {i * 'x'}".encode(), version=f"WARC/1.{i % 2}") for i in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
    again = warc.read_records(spark, str(tmp_path))
    assert sorted(bytes(r.record).rstrip(b"\r\n") for r in again.collect()) == sorted(records)
    got = warc.derivatives(again).collect()
    assert len(got) == 10 and {r.kind for r in got} == {"metadata", "conversion"}


def test_warc_bodies_are_decoded():
    page = b"<title>T</title><p>One paragraph, with words.</p>" * 3
    chunked = b"".join(b"%x;n=1\r\n%s\r\n" % (len(page[i : i + 20]), page[i : i + 20]) for i in range(0, len(page), 20)) + b"0\r\n\r\n"
    want = conversion(crawled(page))["conversion"]
    assert want.count("One paragraph") == 3
    raw = zlib.compressobj(wbits=-15)
    for body, http in (
        (chunked, ["Transfer-Encoding: chunked"]), (gzip.compress(page), ["Content-Encoding: gzip"]), (zlib.compress(page), ["Content-Encoding: deflate"]),
        (raw.compress(page) + raw.flush(), ["Content-Encoding: deflate"]), (gzip.compress(page[:50]) + gzip.compress(page[50:]), ["Content-Encoding: gzip"]),
        (page, ["Transfer-Encoding: chunked", "Content-Encoding: gzip"]), (page, ["Content-Encoding: br"]),
    ):
        assert conversion(crawled(body, *http))["conversion"] == want, http


def test_warc_links_and_ids():
    page = (
        '<a data-href="no" title="an href=no" href="/a?x=1&amp;y=2">a</a><!-- <a href="no"> --><script src=s.js>"<a href=no>"</script>'
        "<img alt='5\" screen' src='i.png'/><a title=don't href=b>b</a><abbr href=no><a name=x>"
    )
    assert warc.links_of(page) == [
        {"path": "a@/href", "url": "/a?x=1&y=2"}, {"path": "script@/src", "url": "s.js"}, {"path": "img@/src", "url": "i.png"}, {"path": "a@/href", "url": "b"},
    ]
    ids = [dict(warc.parse_record(warc.response_record("http://x", "same", d))[0])["WARC-Record-ID"] for d in ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", None)]
    assert len(set(ids)) == 3


def test_token_counts(odd, none):
    got = document_token_counts(odd, PATH, 50256).collect()
    assert len(got) == 9 and all(r.closed for r in got)
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (1, 2, 4)} == {1: 0, 2: 0, 4: 1}
    assert document_token_counts(none, PATH, 50256).count() == 0


def test_bpe(odd, none):
    got = {r.doc_id: r for r in encoded_documents(odd, PATH).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[1].n_tokens == 0 and got[1].ids_sha256 == got[2].ids_sha256 == got[1].decoded_sha256 == nothing
    assert got[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert encoded_documents(none, PATH).count() == 0


def test_decode_odd_ids(spark):
    ids = spark.createDataFrame([(None,), ([],), ([-1, 10 ** 6, 0],), ([50256],)], "ids array<int>")
    assert [r[0] for r in ids.select(bpe.decode(F.col("ids"), PATH)).collect()] == ["", "", "!", "<|endoftext|>"]


def test_sharding(odd, none):
    got = sharding.assign_shards(odd, 4).collect()
    assert len(got) == 9 and sharding.assign_shards(none, 4).count() == 0
    assert {(r["size"], r.text_crc32) for r in got if r.doc_id in (1, 2)} == {(8, 0)}
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_html():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    assert html_text.main_text("<p>" + "long text, " * 50_000) == ("long text, " * 50_000).strip()
    assert html_text.main_text("a<b" * 1000)
    assert html_text.main_text("<a " + '"' * 5001 + "<p>x") == ""


def test_backoff(odd, none):
    got = {r.doc_id: r for r in backoff_scores(odd).collect()}
    assert got[1].n_words == 0 and got[1].score == 0 and got[5].n_words == 120_000 and got[None].n_words == 3
    assert backoff_scores(none).count() == 0


def test_jaccard(odd, none):
    rows = jaccard_join.jaccard_groups(odd).collect()
    assert len(rows) == 9 and jaccard_join.jaccard_groups(none).count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == (0, 1) and got[3] == (0, 3) and got[4] == got[6] == got[7] == (1, 4) and got[None] == (1, None)
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5]


def test_secrets(spark, odd, none):
    assert secrets.secret_spans(odd).count() == 9 and secrets.secret_spans(none).count() == 0
    masked = secrets.mask_secrets(odd)
    assert masked.columns == odd.columns and masked.exceptAll(odd).count() == 0
    one = frame(spark, [(1, "token = 04dbebab91ab85687d33eeaaf9ac699e, é")]).withColumn("n_chars", F.lit(43).cast("long"))
    row = secrets.mask_secrets(one).first()
    assert row.text == "[secret], é" and row.n_chars == 11


def test_pipeline_on_an_empty_table(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark(spark, []).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_html_stray_quotes():
    assert html_text.main_text("<article><p>one</p><a title=don't href=x>two</a><p>three</p></article>") == "one two three"
    assert html_text.main_text('<p>one</p><img alt="5" screen" src="x.png"><p>two</p><p class="k">three</p>') == "one two three"
    assert html_text.main_text("<p>one</p><p title=\"x>y\" id='>'>two</p><p lang=\"never closed>three</p><p>four</p>") == "one two three four"


def test_html_marks_are_weighed():
    part = "".join(f"<p>A paragraph of the article, number {i}, with commas and a full stop. It goes on, as they do.</p>" for i in range(5))
    comments = '<div class="comment"><p>I like this, very much. Thank you, it was good.</p></div>' * 12
    for wrapper in ("content-sidebar-wrap", "has-sidebar", "elementor-widget post-content", "with-header nav-fixed"):
        got = html_text.main_text(f'<div class="{wrapper}"><article><h1>Title</h1>{part}</article><div class="comments">{comments}</div></div>')
        assert got.startswith("Title A paragraph") and got.count("A paragraph") == 5 and "I like" not in got
        assert html_text.main_text(f'<div class="{wrapper}">{part}</div><div>Site, all.</div>').count("A paragraph") == 5
    got = html_text.main_text(
        f'<article>{part}<section id="discussion"><h2>Discussion</h2>{part}</section><div class="related-work">{part}</div><div class="ad">Buy, now.</div>'
        f'<div class="comments">{comments}</div></article>'
    )
    assert got.count("A paragraph") == 15 and "Discussion" in got and "Buy" not in got and "I like" not in got


def test_html_chosen_blocks_are_kept():
    line = "Words of the text, with commas, and a full stop. "
    want = "Title A lead, which is short. " + line * 20 + "A closing paragraph, with its words, and its stop."
    for tag in ("div", "li", "blockquote", "pre", "td"):
        page = f"<h1>Title</h1><p>A lead, which is short.</p><{tag} class=\"body\">{line * 20}</{tag}><p>A closing paragraph, with its words, and its stop.</p>"
        assert html_text.main_text(f"<article>{page}</article>") == want
        assert html_text.main_text(f"<body><div><ul><li><a href=/>Home</a></ul></div><article>{page}</article></body>") == want
    part = "".join(f"<p>{line * 3}</p>" for _ in range(12))
    got = html_text.main_text(f"<div><h1>Title</h1><div>{part}</div><p>{line * 2}</p></div>")
    assert got == "Title " + (line * 38).strip()
    assert html_text.main_text(f"<div><h1>{line * 3}</h1><p>Short, so.</p></div>") == (line * 3).strip() + " Short, so."


@pytest.mark.parametrize("copies", [1, 30])
@pytest.mark.parametrize("n_plain", [3, 0])
def test_many_keys_are_no_background(spark, copies, n_plain):
    random.seed(10)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(random.choice(letters) for _ in range(32)) for _ in range(500)]
    plain = ["internationally", "understanding,", "straightforward", "10.200.30.4", "mail-2024.example.com", "chapter-12-section-3"]
    texts = [f"password: {k} here" for k in keys[:100]]
    texts += [f"see {k} " + " ".join(random.choice(plain) for _ in range(n_plain)) for k in keys[100:]]
    texts += [f"see {keys[100]} again {keys[101]}"] * (300 * (copies - 1) // 29)
    rows = secrets.secret_spans(frame(spark, list(enumerate(texts)))).collect()
    found = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == 3} for r in rows}
    assert sum((4, 36) in found[i] for i in range(100, 500)) >= 380
    assert all(spans <= {(4, 36), (43, 75)} for i, spans in found.items() if i >= 100)


def test_parts_of_runs_outside_base_spans():
    key = "Zq7Xw2Lk9Pv4Rt8Ym3Bn"
    text = f"{key}/0123456789abcdef0123/{key} x password={key}"
    base = secrets.base_spans(text)
    assert [c[2] for c in secrets.candidates(text, base, 12)] == [key + "/", "/" + key]


STORY = "<p>This is the first paragraph, with several words, and commas.</p><p>The second goes on, and on, until the end.</p>"
TOLD = "This is the first paragraph, with several words, and commas. The second goes on, and on, until the end."


@pytest.mark.parametrize("page", [
    '<div style="overflow:hidden"><article>{}</article></div>', '<article><div style="overflow:hidden">{}</div></article>',
    '<article title="the hidden cost">{}</article>', '<article data-hidden="false">{}</article>', '<article data-role="dialog">{}</article>',
    '<form id="aspnetForm" method="post"><input type="hidden" name="x"><div>{}</div></form>',
    '<article>{}</article><form action="/find"><label>Your name, please, now.</label><input></form>',
    "<article>{}</article><p hidden>Not shown, at all, to anybody.</p><div role=dialog>Accept, please, all of it.</div>",
])
def test_attributes_are_told_by_their_exact_names(page):
    assert html_text.main_text(page.format(STORY)) == TOLD


def test_an_article_of_links_has_their_text():
    assert html_text.main_text('<nav>a</nav><article><p><a href="x">Only a link here</a></p></article>') == "Only a link here"
