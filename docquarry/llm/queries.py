"""The corpus operators as registered queries, each over its whole table, beside their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, decontaminate, secrets, sharding, warc
from docquarry.llm import host_quality as hq
from docquarry.llm.backoff import backoff_scores
from docquarry.llm.common import ORACLES, QUERIES, register, table  # noqa: F401
from docquarry.llm.html_text import main_texts
from docquarry.llm.jaccard_join import jaccard_groups
from docquarry.llm.repeats import strip_repeats
from docquarry.llm.spelling import spelling_groups
from docquarry.llm.token_scan import document_token_counts
from docquarry.llm.vector_codes import VectorCode, code_vectors

SHARDS = 24
BPE_FILE = "byte_bpe_50k.json"
EOD = 50256

SQL_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_RULE_SQL = """
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeated,
    100 * n_symbols > 50 * word_chars AS symbols, 100 * n_dup_lines > 50 * n_lines AS lines FROM measured
"""


def _host_sql() -> str:
    unpivot = " UNION ALL ".join(f"SELECT source, '{r}' AS rule, n, f_{r} AS f FROM counts" for r in hq.RULES)
    sums = ", ".join(f"sum({r}::int) AS f_{r}" for r in hq.RULES)
    return f"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {SQL_WORDS.format(text="text")} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, words[i : i + 7] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM texts)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(0, 8)) AS p FROM twice) GROUP BY doc_id
), measured AS (
  SELECT t.doc_id, source, len(words)::bigint AS n_words, len(array_to_string(words, ''))::bigint AS word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, len(lines)::bigint AS n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(c.n, 0)::bigint AS n_repeat_words
  FROM texts t LEFT JOIN covered c USING (doc_id)
), ruled AS ({_RULE_SQL}), counts AS (
  SELECT source, count(*) AS n, {sums} FROM ruled WHERE source IS NOT NULL GROUP BY source
), tall AS ({unpivot}), fitted AS (
  SELECT rule, any_value(m) AS m, sum(n * (f / n - m) ** 2) AS s, sum((n - 1) * (1 - n / total)) AS room, count(*) AS k FROM (
    SELECT *, sum(f) OVER (PARTITION BY rule) / sum(n) OVER (PARTITION BY rule) AS m, sum(n) OVER (PARTITION BY rule) AS total FROM tall)
  GROUP BY rule
), prior AS (
  SELECT rule, m, least(greatest(CASE WHEN m > 0 AND m < 1 AND room > 0 THEN (s / (m * (1 - m)) - (k - 1)) / room ELSE 0 END, 1e-6), 1 / 11.0::double) AS rho
  FROM fitted
), rejected AS (
  SELECT DISTINCT source FROM tall JOIN prior USING (rule) WHERE (f + m * (1 - rho) / rho) / (n + (1 - rho) / rho) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeated AS base_failed,
  NOT (short OR repeated) AND (source IS NULL OR source NOT IN (SELECT source FROM rejected)) AS kept
FROM ruled
"""


@register(_host_sql())
def op1_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Rule counts, the base verdict and the verdict with the host's, for every document."""
    return hq.host_quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _jump_sql(key: str, shards: int) -> str:
    """Jump hash as a recursive query over the distinct keys; unsigned 64-bit steps in 128-bit integers."""
    return f"""
  SELECT k, max(b) FILTER (WHERE b < {shards}) AS shard FROM (
    WITH RECURSIVE jump AS (
      SELECT DISTINCT {key} AS k, {key}::hugeint AS state, 0::bigint AS b FROM documents
      UNION ALL
      SELECT k, nxt, (floor((b + 1) * (2147483648.0::double / ((nxt // 8589934592::hugeint) + 1)::double)))::bigint
      FROM (SELECT k, b, ((state * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint) AS nxt FROM jump WHERE b < {shards})
    ) SELECT k, b FROM jump) GROUP BY k
"""


# The checksum's table for four bits at a time, by its rule: the reflected polynomial, applied once per set low bit.
_CRC_TABLE = [0] * 16
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC_TABLE[_i] = _c
SQL_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(regexp_replace(hex(encode({text})), '(.)(.)', "
    "'\\2\\1', 'g'), ''), lambda h: (instr('0123456789ABCDEF', h) - 1)::bigint)), "
    f"lambda c, x: CASE WHEN x < 0 THEN c ELSE xor(c >> 4, ({_CRC_TABLE}::bigint[])[(xor(c, x) & 15) + 1]) END), 4294967295::bigint)"
)


@register(f"""
WITH s AS ({_jump_sql('doc_id', SHARDS)}), g AS ({_jump_sql('doc_id', SHARDS + 1)}), sized AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 8)::bigint AS size, {SQL_CRC32.format(text="coalesce(text, '')")} AS text_crc32 FROM documents)
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, s.shard::int AS shard,
  (row_number() OVER (PARTITION BY s.shard ORDER BY d.doc_id) - 1)::bigint AS slot, g.shard::int AS grown_shard
FROM sized d JOIN s ON s.k = d.doc_id JOIN g ON g.k = d.doc_id
""")
def op6_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document among 24 shards, and its shard with one shard more."""
    placed = sharding.assign_shards(table(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from them."""
    return docs.select("doc_id", bpe.round_trip(F.col("text"), path).alias("t")).select("doc_id", "t.*").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register()
def op5_trie_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return encoded_documents(table(spark, folder, "documents"), public_tokenizers.path(BPE_FILE))


@register(f"""
WITH texts AS (
  SELECT doc_id, {SQL_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM texts
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  WITH RECURSIVE walk AS (
    SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT walk.a, links.b FROM walk JOIN links ON links.a = walk.b
  ) SELECT a, min(b) AS component_id FROM walk GROUP BY a
)
SELECT doc_id, len(s)::bigint AS n_shingles, component_id FROM sets JOIN reach ON a = doc_id
""")
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word n-gram sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_groups(table(spark, folder, "documents"))


def _seed_sql(ids: str, words: str, source: str, full: bool) -> str:
    """Words under each mask at each place, joined by a blank; past the end there is no word."""
    parts = []
    for m, mask in enumerate(decontaminate.MASKS):
        text = ", ".join(f"{words}[i + {o}]" for o in mask)
        span = f"AND i + {max(mask)} <= len({words})" if full else ""
        parts.append(
            f"SELECT {ids}, {m} AS mask, i, concat_ws(' ', {text}) AS seed FROM "
            f"(SELECT *, unnest(range(1, len({words}) + 1)) AS i FROM {source}) WHERE true {span}"
        )
    return " UNION ALL ".join(parts)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(f"""
WITH d AS (SELECT doc_id, {SQL_WORDS.format(text=_LOWER)} AS w FROM documents),
b AS (SELECT item_id, {SQL_WORDS.format(text=_LOWER)} AS v FROM benchmark),
hits AS (
  SELECT DISTINCT doc_id, item_id, x.i - y.i AS shift FROM ({_seed_sql('doc_id', 'w', 'd', False)}) x
  JOIN ({_seed_sql('item_id', 'v', 'b', True)}) y USING (mask, seed)
  UNION SELECT doc_id, item_id, i - 1 FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)
  JOIN (SELECT * FROM b WHERE len(v) BETWEEN 5 AND 7) s ON w[i : i + len(v) - 1] = v
), same AS (
  SELECT doc_id, item_id, shift, j, CASE WHEN shift + j >= 1 AND w[shift + j] = v[j] THEN 1 ELSE 0 END AS hit
  FROM (SELECT doc_id, item_id, shift, w, v, unnest(range(1, len(v) + 1)) AS j FROM hits JOIN d USING (doc_id) JOIN b USING (item_id))
), summed AS (
  SELECT *, sum(hit) OVER w AS hits, sum(CASE hit WHEN 1 THEN 1 ELSE -3 END) OVER w AS score FROM same
  WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY j)
), edges AS (
  SELECT doc_id, item_id, shift, j, hits, score FROM summed UNION ALL SELECT doc_id, item_id, shift, 0, 0, 0 FROM hits
), stretch AS (
  SELECT e.doc_id, e.item_id, e.shift, s.j AS first, e.j - s.j AS span, e.hits - s.hits AS matched,
    row_number() OVER (PARTITION BY e.doc_id, e.item_id, e.shift ORDER BY e.score - s.score DESC, e.j, s.j DESC) AS rank
  FROM edges e JOIN edges s ON e.doc_id = s.doc_id AND e.item_id = s.item_id AND e.shift = s.shift AND s.j < e.j
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, span, shift + first) AS best
  FROM stretch JOIN (SELECT item_id, max(len(v)) AS n FROM b GROUP BY item_id) USING (item_id) WHERE rank = 1 AND matched >= least(10, n)
)
SELECT doc_id, item_id, matched::bigint AS n_matched, span::bigint AS n_span, (shift + first)::bigint AS start FROM ranked WHERE best = 1
""")
def op2_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, replaced words tolerated."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register()
def op10_secret_grammar(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of credentials in every document: those of the base patterns and those the inferred formats add."""
    spans = secrets.secret_spans(table(spark, folder, "documents"))
    # A second parameter of the function given to filter() would be the position in the array, not a kind.
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    count = [number(kind).alias(f"n_{name}") for kind, name in enumerate(secrets.KINDS[:3])]
    return spans.select(
        "doc_id", *count, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans")
    )


@register()
def op7_tag_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The article text of every page."""
    text = table(spark, folder, "pages").select("page_id", "url", main_texts(F.col("html")).alias("text"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@register(f"""
WITH w AS (SELECT doc_id, instr('0123456789abcdef', substr(md5(coalesce(text, '')), 1, 1)) % 4 AS fold, {SQL_WORDS.format(text=_LOWER)} AS w
  FROM documents
), t AS (SELECT doc_id, fold, i, w[i] AS v, CASE WHEN i > 1 THEN w[i - 1] END AS u
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)
), f1 AS (SELECT v, fold, count(*) AS n FROM t GROUP BY ALL
), f2 AS (SELECT u, v, fold, count(*) AS n FROM t WHERE u IS NOT NULL GROUP BY ALL
), c1 AS (SELECT v, fold, sum(n) OVER (PARTITION BY v) - n AS n FROM f1
), c2 AS (SELECT u, v, fold, sum(n) OVER (PARTITION BY u, v) - n AS n FROM f2
), total AS (SELECT fold, greatest(sum(sum(n)) OVER () - sum(n), 1) AS n FROM f1 GROUP BY fold
), s AS (
  SELECT doc_id, count(*) FILTER (t.u IS NOT NULL AND c2.n = 0) AS n_backoff,
    sum(CASE WHEN c2.n > 0 THEN ln(c2.n) - ln(cu.n)
      ELSE CASE WHEN t.u IS NULL THEN 0 ELSE ln(0.4) END + ln(greatest(c1.n, 1)) - ln(total.n) END) AS score
  FROM t JOIN c1 ON c1.v = t.v AND c1.fold = t.fold JOIN total ON total.fold = t.fold
    LEFT JOIN c1 cu ON cu.v = t.u AND cu.fold = t.fold LEFT JOIN c2 ON c2.u = t.u AND c2.v = t.v AND c2.fold = t.fold
  GROUP BY doc_id
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(score, 0), 4) + 0.0 AS score,
  round(coalesce(score, 0) / greatest(len(w), 1), 5) + 0.0 AS score_per_word
FROM w LEFT JOIN s USING (doc_id)
""")
def op8_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document under the bigram counts of the documents in the other folds, with the words that backed off."""
    scores = backoff_scores(table(spark, folder, "documents"))
    return scores.select(
        "doc_id", "n_words", "n_backoff", (F.round("score", 4) + 0.0).alias("score"),
        (F.round(F.col("score") / F.greatest("n_words", F.lit(1)), 5) + 0.0).alias("score_per_word"),
    )


@register()
def op3_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion records of the response record of every page."""
    pages = table(spark, folder, "pages")
    records = pages.select("page_id", warc.responses(F.col("url"), F.col("html")).alias("record"))
    return warc.derivatives(records, keep=("page_id",)).withColumn("record", F.col("record").cast("string"))


@register()
def op4_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Token count of every document, found again in flat token files written from all documents."""
    counts = document_token_counts(table(spark, folder, "documents"), public_tokenizers.path(BPE_FILE), EOD)
    return counts.select("doc_id", "n_tokens", "closed")


@register("""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS p FROM d)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS nth FROM w) WHERE nth > 1
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
    SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
      SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM later))
  GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM runs
  UNION ALL SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS x FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
  sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op11_run_index(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the strings of 100 bytes that also begin earlier."""
    kept = strip_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return kept.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@register(f"""
WITH runs AS (
  SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  GROUP BY doc_id, run HAVING length(run) >= 5
), summed AS (SELECT run, c, {SQL_CRC32.format(text="coalesce(doc_id::varchar, '') || ':' || run")} AS h FROM runs
), v AS (
  SELECT word, sum(c)::bigint AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cut AS (SELECT word, n, length(word) AS m, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM v)
), pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.m = b.m AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, cut.word, cut.n FROM v JOIN cut ON cut.rest = v.word
  UNION SELECT cut.word, v.word, v.n FROM v JOIN cut ON cut.rest = v.word
), best AS (
  SELECT a, n_near, b, n FROM (SELECT *, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS nth FROM pairs) WHERE nth = 1
), f AS (
  SELECT word, v.n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN best.n >= 2 * v.n THEN b END AS form, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n
  FROM v LEFT JOIN best ON a = word
), walk AS (
  WITH RECURSIVE steps AS (SELECT word, word AS top FROM f UNION ALL SELECT steps.word, f.form FROM steps JOIN f ON f.word = top WHERE f.form IS NOT NULL)
  SELECT steps.word, top FROM steps JOIN f ON f.word = top WHERE f.form IS NULL
)
SELECT f.word, f.n, n_near, form, form_n, walk.top AS root FROM f JOIN walk USING (word)
""")
def op12_bitslice_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents with its most frequent neighbour and the root of its spelling variants."""
    return spelling_groups(table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


VECTOR_CODE = VectorCode()


def _code_sql(code: VectorCode) -> str:
    """The rounds of k-means one after another, each a query over the parts and the codebook before."""
    steps = [f"""
k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({code.scale} * x::double)::bigint) AS v, len(embedding) // {code.parts} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT vec_id, label, part, v[part * w + 1 : (part + 1) * w] AS x FROM k, range({code.parts}) t(part)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {code.entries})
)"""]
    gap = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    for r in range(code.rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, part, any_value(label) AS label, any_value(x) AS x, min(d * {code.entries} + e) AS best FROM (
    SELECT p.vec_id, p.part, p.label, p.x, c.e, {gap} AS d FROM p JOIN c{r} c ON c.part = p.part) GROUP BY vec_id, part
)""")
        if r < code.rounds:
            steps.append(f"""m{r} AS (
  SELECT part, e, list(floor(total / n)::bigint ORDER BY i) AS x FROM (
    SELECT part, best % {code.entries} AS e, i, sum(x[i])::double AS total, count(*) AS n FROM (
      SELECT part, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY part, e
), c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.e = c.e
)""")
    last = code.rounds
    return f"""
WITH {", ".join(steps)}, coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', (best % {code.entries})::int), '' ORDER BY part) AS code,
    sum(best // {code.entries})::bigint AS error FROM a{last} GROUP BY vec_id
), book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS h FROM c{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, h AS codebooks_sha256 FROM coded, book
"""


@register(_code_sql(VECTOR_CODE))
def op13_gnat_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Product codes of all vectors under codebooks trained on all of them."""
    coded = code_vectors(table(spark, folder, "embeddings"), VECTOR_CODE)
    digits = F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0")))
    return coded.select("vec_id", F.concat_ws("", digits).alias("code"), "error", "label_error", "codebooks_sha256")
