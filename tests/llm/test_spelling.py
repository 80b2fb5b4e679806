"""Spelling variants: bit sets against edit distance, the job against plain Python, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docquarry.llm import spelling
from docquarry.llm.queries import op12_bitslice_spelling
from docquarry.llm.spelling import BitIndex, neighbours, spelling_groups, unpacked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def letters(words, width):
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "abcdefghijklmnopqrstuvwxyzÿ"])
def test_bit_sets_equal_edit_distance(alphabet):
    random.seed(len(alphabet))
    words = sorted({"".join(random.choice(alphabet) for _ in range(random.randint(1, 9))) for _ in range(150)})
    index = BitIndex(letters(words, 9))
    for length in range(1, 11):
        queries = [w for w in words if len(w) == length] + ["".join(random.choice(alphabet + "q") for _ in range(length)) for _ in range(40)]
        everything = np.full((len(queries), index.width), np.uint64(0xFFFFFFFFFFFFFFFF))
        got = unpacked(index.near(letters(queries, length), everything), len(words))
        for q, row in zip(queries, got):
            assert [w for w, hit in zip(words, row) if hit] == [w for w in words if one_apart(q, w)]
        beyond = unpacked(index.near(letters(queries, length), everything, beyond=length // 2), len(words))
        for q, row in zip(queries, beyond):
            assert [w for w, hit in zip(words, row) if hit] == [w for w in words if one_apart(q, w) and w[: length // 2] != q[: length // 2]]


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    vocabulary = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_cut, near = {}, {w: set() for w in vocabulary}
    for w in vocabulary:
        for i in range(len(w)):
            by_cut.setdefault((w[:i], w[i + 1 :]), []).append(w)
    for (a, b), group in by_cut.items():
        whole = [w for w in [a + b] if w in vocabulary]
        for w in group:
            near[w].update(x for x in group if x != w)
            near[w].update(whole)
        for w in whole:
            near[w].update(group)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best and vocabulary[best] >= 2 * vocabulary[w] else None
    out = []
    for w in vocabulary:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, vocabulary[w], len(near[w]), vocabulary[form[w]] if form[w] else None))
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus():
    random.seed(6)
    base = ["".join(random.choice("abcde") for _ in range(random.randint(4, 9))) for _ in range(60)] + ["straße", "ÀÉÎÕÜ", "x" * 300]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = random.choice(base[: random.randint(1, len(base))])
            if random.random() < 0.3:
                at = random.randrange(len(w))
                w = w[:at] + random.choice(["", "a", "é", w[at] + "b"]) + w[at + 1 :]
            words.append(random.choice([w, w, w.capitalize(), w.upper()]))
        rows.append((i, " ".join(words) + random.choice([".", " 12œuvre", "\n日本x"])))
    return rows


@pytest.mark.parametrize("tile", [2048, 64])
def test_job_equals_plain_python(spark, tile, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    monkeypatch.setattr(spelling, "SHARD_ENTRIES", 500)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain(rows)
    assert sum(r[1] is not None for r in want) > 100 and any(r[2] != r[1] for r in want if r[1])
    assert got(spelling_groups(frame, tile=tile)) == want


def test_large_blocks_are_dealt_to_tiles(spark):
    random.seed(8)
    words = sorted({"prefix" + "".join(random.choice("abcd") for _ in range(5)) for _ in range(900)})
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    found = {r.word: r.n_near for r in neighbours(frame, tile=100).collect()}
    assert found == {w: n for w in words if (n := sum(one_apart(w, x) for x in words))}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word! " * 3), (None, "words words words"), (4, "words Wordy wordy WORDY"), (4, "words Wordy wordy WORDY"), (5, "y" * 100_000)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    assert got(spelling_groups(docs)) == plain(rows)
    assert spelling_groups(docs.limit(0)).collect() == []


def test_query_at_the_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_bitslice_spelling(spark, folder)) == plain(rows)
