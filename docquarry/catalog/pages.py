"""Content blocks, markdown and routing of the raw ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.catalog.base import query, table
from docquarry.operators import blocks
from docquarry.operators.steps import run_steps, run_values
from docquarry.session import spread


@query()
def page_blocks(spark, folder):
    return blocks.extract_blocks(spread(table(spark, folder, "pages").select("page_id", "html")))


@query()
def page_markdown(spark, folder):
    return blocks.to_markdown(spread(table(spark, folder, "pages").select("page_id", "html")))


@query(r"""
SELECT page_id, text_chars, CASE WHEN text_chars < 100 THEN 'ocr' ELSE 'txt' END AS route
FROM (SELECT page_id, length(trim(regexp_replace(regexp_replace(html,
    '(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_chars FROM pages)
""")
def page_route(spark, folder):
    routed = blocks.route_pages(table(spark, folder, "pages").select("page_id", "html"))
    return routed.select("page_id", F.col("text_chars").cast("long").alias("text_chars"), "route")


@query("""
SELECT page_id, 'txt' AS route FROM (SELECT page_id, length(trim(regexp_replace(regexp_replace(html,
    '(?is)<(script|style)\\b.*?</(script|style)\\s*>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_chars FROM pages)
WHERE text_chars >= 100
""")
def declared_steps(spark, folder):
    """A chain of operators declared as a list: route pages, keep those with a long enough text layer."""
    routed = run_steps(
        table(spark, folder, "pages").select("page_id", "html"),
        [{"route_pages": None}, {"min_score": {"threshold": 100, "score": "text_chars"}}],
    )
    return routed.select("page_id", "route")


@query(r"""
WITH a AS (SELECT page_id, trim(regexp_replace(regexp_replace(html,
    '(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS v FROM pages),
b AS (SELECT page_id, v, CASE WHEN v IS NULL THEN '0 input' WHEN length(v) < 800 THEN '3 at_least'
    WHEN regexp_matches(v, '[0-9]{5}') THEN '4 without' END AS stopped_at FROM a)
SELECT page_id, CASE WHEN stopped_at IS NULL THEN lower(substr(v, 1, 40)) END AS value, stopped_at FROM b
""")
def chained_values(spark, folder):
    """Pages through a chain of steps: a page that a step leaves without a value stops there and says where."""
    return run_values(table(spark, folder, "pages").select("page_id", "html"), [
        {"strip_markup": None}, {"squeeze_space": None}, {"at_least": {"n": 800}}, {"without": {"pattern": "[0-9]{5}"}},
        {"first_chars": {"n": 40}}, {"lower": None},
    ], "html").drop("html")
