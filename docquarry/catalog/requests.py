"""Request bodies, usage and request logs, made from ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.catalog.base import query, table
from docquarry.functions.keys import elapsed_seconds
from docquarry.functions.payload import as_text_list, chat_request, classify_requests as classify, token_usage as usage
from docquarry.operators import reports
from docquarry.operators.boxes import min_score as at_least
from docquarry.functions.vectors import yes_probability as yes
from docquarry.operators.fusion import history_prompt

_BODIES_SQL = """
bodies AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'embeddings' ELSE 'rerank' END AS endpoint,
    CASE turn WHEN 0 THEN to_json({'input': text, 'query': text, 'documents': [text, role]})::varchar
        WHEN 1 THEN to_json({'input': [text], 'query': text, 'documents': role})::varchar
        WHEN 2 THEN to_json({'model': role})::varchar WHEN 3 THEN '{}' WHEN 4 THEN text WHEN 5 THEN ''
        WHEN 6 THEN to_json({'input': 5, 'query': text, 'documents': []})::varchar ELSE to_json({'input': '', 'query': ''})::varchar END AS body
    FROM conversations)
"""


def bodies(spark, folder):
    """One request per turn; the turn number decides what is wrong with it."""
    turn, text, role = F.col("turn"), F.col("text"), F.col("role")
    whole = F.to_json(F.struct(text.alias("input"), text.alias("query"), F.array(text, role).alias("documents")))
    listed = F.to_json(F.struct(F.array(text).alias("input"), text.alias("query"), role.alias("documents")))
    number = F.to_json(F.struct(F.lit(5).alias("input"), text.alias("query"), F.array().cast("array<string>").alias("documents")))
    body = (
        F.when(turn == 0, whole).when(turn == 1, listed).when(turn == 2, F.to_json(F.struct(role.alias("model"))))
        .when(turn == 3, "{}").when(turn == 4, text).when(turn == 5, "").when(turn == 6, number)
        .otherwise('{"input":"","query":""}')
    )
    endpoint = F.when(role == "user", "embeddings").otherwise("rerank")
    return table(spark, folder, "conversations").select("conv_id", "turn", endpoint.alias("endpoint"), body.alias("body"))


@query(f"""
WITH {_BODIES_SQL},
parsed AS (SELECT *, json_valid(body) AS valid, CASE WHEN json_valid(body) THEN body::json END AS j FROM bodies)
SELECT conv_id, turn, endpoint, CASE
    WHEN trim(body) = '' OR body = '{{}}' THEN 'missing_body'
    WHEN NOT valid OR json_type(j) <> 'OBJECT' THEN 'invalid_json'
    WHEN endpoint = 'embeddings' AND coalesce(j->>'input', '') IN ('', '[]', '0') THEN 'missing_input'
    WHEN endpoint = 'embeddings' AND json_type(j, '$.input') NOT IN ('VARCHAR', 'ARRAY') THEN 'invalid_input'
    WHEN endpoint = 'rerank' AND coalesce(j->>'query', '') = '' THEN 'missing_query'
    WHEN endpoint = 'rerank' AND (coalesce(json_type(j, '$.documents'), 'NULL') <> 'ARRAY' OR j->>'documents' = '[]')
        THEN 'invalid_documents'
    ELSE 'ok' END AS error_code
FROM parsed
""")
def classify_requests(spark, folder):
    return classify(bodies(spark, folder)).select("conv_id", "turn", "endpoint", "error_code")


@query("""
SELECT conv_id, turn, pos, CASE WHEN pos = 0 THEN text ELSE role END AS item
FROM conversations, generate_series(0, 1) g(pos) WHERE pos = 0 OR role <> 'user'
""")
def unify_input(spark, folder):
    """A single string (users) or an array (others) becomes an array; one row per item."""
    one = F.get_json_object(F.to_json(F.struct(F.array("text").alias("v"))), "$.v[0]")
    raw = F.when(
        F.col("role") == "user", F.regexp_extract(F.to_json(F.struct(F.col("text").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    ).otherwise(F.to_json(F.array(one, "role")))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.posexplode(as_text_list(raw)).alias("pos", "item")
    ).withColumn("pos", F.col("pos").cast("long"))


@query(r"""
SELECT conv_id, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) + 1)::bigint AS prompt_tokens,
    sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) + 1)::bigint AS total_tokens
FROM conversations GROUP BY conv_id
""")
def token_usage(spark, folder):
    """Whitespace tokens of text and role per conversation."""
    return usage(table(spark, folder, "conversations"), "conv_id", ["text", "role"])


@query("""
SELECT user_id, event_type, count(*) AS requests, round(sum(value), 2) AS total_seconds, round(max(value), 2) AS max_seconds
FROM events GROUP BY ALL
""")
def request_summary(spark, folder):
    return reports.request_summary(table(spark, folder, "events"), ["user_id", "event_type"], "value")


@query("""
SELECT conv_id % 10 AS file_id, count(*) FILTER (length(text) <= 120) AS written, count(*) FILTER (length(text) > 120) AS errors
FROM conversations GROUP BY ALL
""")
def ingest_report(spark, folder):
    from docquarry.operators.validate import validate_lengths

    checked = validate_lengths(table(spark, folder, "conversations"), {"text": 120})
    return reports.ingest_report(checked.withColumn("file_id", F.col("conv_id") % 10))


@query("""
SELECT event_id, round((epoch_us(ts) - epoch_us(date_trunc('minute', ts))) / 1e6, 2) AS seconds FROM events
""")
def request_age(spark, folder):
    """Seconds between two times of a request log."""
    return table(spark, folder, "events").select(
        "event_id", elapsed_seconds(F.date_trunc("minute", F.col("ts").cast("timestamp")), F.col("ts").cast("timestamp")).alias("seconds")
    )


@query("""
SELECT event_id, round(1 / (1 + exp(((props->>'k')::int - 50) / 10.0::double - value / 10.0::double)), 6) AS probability FROM events
""")
def yes_probability(spark, folder):
    no = (F.get_json_object("props", "$.k").cast("int") - 50) / F.lit(10.0)
    return table(spark, folder, "events").select(
        "event_id", F.round(yes(no, F.col("value") / F.lit(10.0)), 6).alias("probability")
    )


@query("SELECT event_id, user_id, value FROM events WHERE value >= 20.5")
def min_score(spark, folder):
    """Inclusive score threshold."""
    return at_least(table(spark, folder, "events"), 20.5, "value").select("event_id", "user_id", "value")


@query("SELECT conv_id, turn, true AS rerank, false AS stream, 1::bigint AS user_id, role || chr(10) || text AS prompt FROM conversations")
def chat_requests(spark, folder):
    """Chat request bodies with defaults filled in, and history with question as one prompt."""
    body = F.to_json(F.struct(F.col("text").alias("question"), F.array("role").alias("chat_history")))
    parsed = table(spark, folder, "conversations").select("conv_id", "turn", chat_request(body).alias("r"))
    return parsed.select(
        "conv_id", "turn", "r.rerank", "r.stream", "r.user_id", history_prompt(F.col("r.chat_history"), F.col("r.question")).alias("prompt")
    )
