"""Request and response bodies of the embedding and rerank interfaces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from docquarry.functions.common import as_column
from docquarry.functions.text import whitespace_tokens
from docquarry.schemas import ERROR


@F.arrow_udf(BinaryType())
def pack_floats(vectors: pa.Array) -> pa.Array:
    """Little-endian float32 bytes of each vector."""
    values = np.asarray(vectors.values.cast(pa.float32()), dtype="<f4")
    bounds = np.asarray(vectors.offsets)
    return pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())


@F.arrow_udf(ArrayType(FloatType()))
def unpack_floats(blobs: pa.Array) -> pa.Array:
    """Vectors of little-endian float32 bytes; null stays null, a broken length becomes null."""
    rows = [
        None if b is None or len(b) % 4 else np.frombuffer(b, "<f4") for b in blobs.to_pylist()
    ]
    return pa.array(rows, pa.list_(pa.float32()))


def as_text_list(raw: str | Column) -> Column:
    """A JSON string or array of strings as an array; null for any other JSON value."""
    raw = F.trim(as_column(raw))
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(
        raw.startswith('"'), F.array(F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0)))
    )


def encode_embedding_payloads(
    df: DataFrame, key: str, vector: str = "embedding", index: str | None = None,
    encoding_format: str = "float", output: str = "payload",
) -> DataFrame:
    """One response element per vector, as JSON: float list or base64 of float32 bytes."""
    position = F.lit(0) if index is None else F.col(index)
    if encoding_format == "float":
        body = F.col(vector)
    elif encoding_format == "base64":
        body = F.base64(pack_floats(F.col(vector)))
    else:
        raise ValueError(f"unknown encoding format {encoding_format!r}")
    element = F.struct(F.lit("embedding").alias("object"), body.alias("embedding"), position.alias("index"))
    return df.withColumn(output, F.to_json(element)).drop(vector)


_ITEM = "struct<object:string, embedding:string, index:int>"
_RESPONSE = f"struct<data:array<{_ITEM}>, embeddings:string, original_shape:string, model:string>"


def decode_embedding_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows ``(index, embedding, size_ok)`` of stored embedding responses, beside the other columns.

    Both response shapes are read: a ``data`` list whose vectors are float lists or base64, and
    one base64 block with an ``original_shape`` of ``(rows, dimensions)``. A body without vectors (broken
    JSON, an error, an empty list, no rows) stays as one row with null index and vector, not ``size_ok``.
    """
    parsed = df.withColumn("__r", F.from_json(F.col(payload), _RESPONSE)).drop(payload)
    shape = F.transform(F.regexp_extract_all("__r.original_shape", F.lit(r"\d+"), F.lit(0)), lambda s: s.cast("int"))
    keep = [c for c in df.columns if c != payload]

    listed = parsed.filter(F.col("__r.data").isNotNull()).select(*keep, F.inline("__r.data"))
    text = F.col("embedding")
    listed = listed.select(
        *keep,
        "index",
        F.coalesce(
            F.from_json(F.when(text.startswith("["), text), "array<float>"),
            unpack_floats(F.unbase64(F.when(~text.startswith("["), text))),
        ).alias("embedding"),
    ).withColumn("size_ok", F.col("embedding").isNotNull())

    whole = parsed.filter(F.col("__r.data").isNull() & F.col("__r.embeddings").isNotNull()).select(
        *keep, shape.alias("__shape"), unpack_floats(F.unbase64("__r.embeddings")).alias("__flat")
    )
    width = F.try_element_at("__shape", F.lit(-1))
    count = F.when(F.size("__shape") > 1, F.get("__shape", F.lit(0))).otherwise(F.lit(1))
    pieces = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.slice(F.col("__flat"), i * width + 1, width)
    )
    whole = whole.select(
        *keep, F.coalesce(F.size("__flat") == count * width, F.lit(False)).alias("size_ok"),
        F.posexplode_outer(F.when(count > 0, pieces)).alias("index", "embedding"),
    )
    # An empty list of vectors has no row in ``listed``.
    listless = F.coalesce(F.size("__r.data"), F.lit(0)) <= 0
    nothing = parsed.filter(listless & (F.col("__r.data").isNotNull() | F.col("__r.embeddings").isNull())).select(
        *keep, F.lit(None).cast("int").alias("index"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(False).alias("size_ok")
    )
    return listed.unionByName(whole).unionByName(nothing)


_REQUEST = "struct<input:string, query:string, documents:string, model:string, top_n:int, dimensions:int>"


def _error(code: str, message: str) -> Column:
    kind = "invalid_request_error"
    return F.struct(
        F.lit(message).alias("message"), F.lit(kind).alias("type"), F.lit(code).alias("code")
    ).cast(ERROR)


def parse_request(body: str | Column) -> Column:
    """Fields of a request body; nested values are kept as their JSON text."""
    return F.from_json(as_column(body), _REQUEST)


def classify_requests(df: DataFrame, endpoint: str = "endpoint", body: str = "body") -> DataFrame:
    """Adds ``error`` (null for a valid request) and ``error_code`` (``ok``).

    ``endpoint`` is ``embeddings`` or ``rerank``. Rows are never dropped.
    """
    raw = F.col(body)
    # A JSON object parses to a map; anything else is not a request.
    fields = F.try_parse_json(raw)
    present = F.trim(F.coalesce(raw, F.lit(""))) != ""
    is_object = F.schema_of_variant(fields).startswith("OBJECT")
    empty = F.schema_of_variant(fields) == "OBJECT<>"

    def kind(path: str) -> Column:
        value = F.try_variant_get(fields, path, "variant")
        return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))

    def text(path: str) -> Column:
        return F.coalesce(F.try_variant_get(fields, path, "string"), F.lit(""))

    def absent(path: str) -> Column:
        """Missing, null, or empty by its type: a string counts by its length, whatever it spells."""
        is_text = kind(path) == "STRING"
        nothing = F.when(is_text, text(path) == "").otherwise(
            text(path).isin("false", "[]", "{}") | (F.try_variant_get(fields, path, "double") == 0)
        )
        return (kind(path) == "VOID") | F.coalesce(nothing, F.lit(False))

    missing_input, missing_query = absent("$.input"), absent("$.query")
    bad_input = ~(kind("$.input").startswith("ARRAY") | (kind("$.input") == "STRING"))
    bad_documents = ~kind("$.documents").startswith("ARRAY") | (text("$.documents") == "[]")
    embeds, reranks = F.col(endpoint) == "embeddings", F.col(endpoint) == "rerank"
    error = (
        F.when(~present | empty, _error("missing_body", "Missing request body"))
        .when(fields.isNull() | ~is_object, _error("invalid_json", "Invalid JSON"))
        .when(embeds & missing_input, _error("missing_input", "Missing 'input' field in request"))
        .when(embeds & bad_input, _error("invalid_input", "'input' must be a string or array of strings"))
        .when(reranks & missing_query, _error("missing_query", "Missing 'query' field in request"))
        .when(reranks & bad_documents, _error("invalid_documents", "Missing or invalid 'documents' field in request"))
    )
    return df.withColumn("error", error).withColumn("error_code", F.coalesce(F.col("error.code"), F.lit("ok")))


def token_usage(df: DataFrame, request_id: str, columns: list[str]) -> DataFrame:
    """Whitespace tokens of the given text columns, summed per request."""
    total = sum((F.coalesce(whitespace_tokens(c), F.lit(0)) for c in columns[1:]),
                F.coalesce(whitespace_tokens(columns[0]), F.lit(0)))
    return df.groupBy(request_id).agg(
        F.sum(total).cast("long").alias("prompt_tokens"), F.sum(total).cast("long").alias("total_tokens")
    )


def chat_request(body: str | Column) -> Column:
    """A chat request body with its defaults filled in."""
    from docquarry.schemas import CHAT_REQUEST

    parsed = F.from_json(as_column(body), CHAT_REQUEST)
    return F.struct(
        F.coalesce(parsed["user_id"], F.lit(1)).alias("user_id"),
        parsed["p_id"].alias("p_id"),
        parsed["question"].alias("question"),
        F.coalesce(parsed["rerank"], F.lit(True)).alias("rerank"),
        F.coalesce(parsed["chat_history"], F.array().cast("array<string>")).alias("chat_history"),
        F.coalesce(parsed["stream"], F.lit(False)).alias("stream"),
    )
