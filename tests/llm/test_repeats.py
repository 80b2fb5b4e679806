"""Removal of repeated byte strings: the index against brute force, and the whole job with every path forced."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import repeats
from docquarry.llm.queries import op11_run_index
from docquarry.llm.repeats import RepeatRule, strip_repeats
from docquarry.llm.run_index import RunIndex


def laid(texts):
    return np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)


def mutated(pool, letters, size):
    if pool and random.random() < 0.5:
        text = bytearray(random.choice(pool))
        for _ in range(random.randint(0, 2)):
            if text:
                text[random.randrange(len(text))] = random.choice(letters)
        return bytes(text)
    return bytes(random.choice(letters) for _ in range(random.randint(0, size)))


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcdefgh"])
def test_index_finds_the_earliest_place(letters):
    random.seed(len(letters))
    for length in range(1, 20):
        texts = []
        for _ in range(12):
            texts.append(mutated(texts, letters, 60))
        want, seen, at = [], {}, 0
        for text in texts:
            for i in range(len(text) + 1):
                window = text[i : i + length]
                want.append(seen.setdefault(window, at + i) if len(window) == length else at + i)
            at += len(text) + 1
        assert RunIndex.build(laid(texts)).earliest(length).tolist() == want


def test_statistics_are_the_longest_match_with_another_suffix():
    random.seed(4)
    texts = []
    for _ in range(8):
        texts.append(mutated(texts, b"abc", 40))
    index = RunIndex.build(laid(texts))
    got = np.maximum(index.statistics()[0], index.statistics(below=True)[0])
    suffixes = [t[i:] for t in texts for i in range(len(t) + 1)]
    for i, a in enumerate(suffixes):
        lengths = [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for j, b in enumerate(suffixes) if j != i]
        assert got[i] == max(lengths)


def test_runs_compress_copies():
    random.seed(5)
    base = bytes(random.choice(b"abcdefgh") for _ in range(400))
    one, many = RunIndex.build(laid([base])), RunIndex.build(laid([base] * 40))
    assert len(many.begins) < len(one.begins) + 2 * 40 < len(many.text) / 10
    assert RunIndex.build(np.zeros(0, np.uint8)).earliest(3).tolist() == []


def brute(rows, length):
    """Covered bytes per row; rows of equal id and text are one document."""
    seen, out = set(), {}
    for doc, text in sorted({(d, t) for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc, text] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n, letters="abcdeé "):
    random.seed(seed)
    passages = ["".join(random.choice(letters) for _ in range(random.randint(20, 90))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(random.randint(0, 6)):
            kind = random.random()
            parts.append(random.choice(passages) if kind < 0.5 else "x" * random.randint(0, 60) if kind < 0.6
                         else "".join(random.choice(letters) for _ in range(random.randint(0, 60))))
        rows.append((i, "".join(parts)))
    return rows + [(n + i, rows[i % n][1]) for i in range(n // 3)]


RULES = [
    RepeatRule(length=24, trigger=10),
    RepeatRule(length=24, trigger=10, shard_bytes=3000, index_bytes=2000),
    RepeatRule(length=24, trigger=10, shard_bytes=3000, index_bytes=2000, index_phrases=3),
    RepeatRule(length=24, trigger=10, shard_bytes=3000, hot_phrases=2),
    RepeatRule(length=9, trigger=8),
]


def result(frame):
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return [tuple(r) for r in frame.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()]


@pytest.mark.parametrize("rule", RULES)
def test_job_equals_brute_force(spark, rule, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 150)
    rows = corpus(7, 120)
    want = brute(rows, rule.length)
    got = result(strip_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rule))
    assert sorted(got) == sorted((d, *v) for (d, _), v in want.items())


def test_long_texts_are_cut_into_pieces():
    random.seed(9)
    rule = RepeatRule(length=24, trigger=10)
    text = bytes(random.choice(b"abcdef") for _ in range(3 * repeats.BLOCK_BYTES + 77))
    covered = np.zeros(len(text), int)
    for _, _, row, start, size in repeats._parse([text, b"short", text[:30]], rule, np.zeros(0, np.uint64)):
        for s, n in zip(start[row == 0].tolist(), size[row == 0].tolist()):
            covered[s : s + n - rule.length + 1] += 1
    assert (covered[: len(text) - rule.length + 1] == 1).all()


def test_odd_rows(spark):
    rule = RepeatRule(length=24, trigger=10)
    long = "the same words again and again, one by one"
    rows = [(5, long), (5, long), (7, long), (None, long), (8, None), (9, ""), (10, "é" * 400), (11, "short")]
    schema = "doc_id bigint, text string, spans string, kept int, doc int, text_hash int"
    docs = spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows], schema)
    want = brute(rows, rule.length)
    assert sorted(result(strip_repeats(docs, rule)), key=repr) == sorted(((d, *want[d, t]) for d, t in rows), key=repr)
    assert want[None, long][1] == 0 and want[5, long][1] == len(long)  # the null id is the earliest
    assert strip_repeats(docs.limit(0), rule).collect() == []


def test_query_at_the_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 100)
    assert sorted(tuple(r) for r in op11_run_index(spark, folder).collect()) == sorted((d, *v) for (d, _), v in want.items())
