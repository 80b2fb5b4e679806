"""Quality rules judged per host.

Each document is tested by a few rules. Failures are added up per host, each host's failure rate is
shrunk towards the rate of the whole corpus by a beta prior that is fitted to all hosts (a host with
few documents says little about itself), and hosts whose shrunk rate is too high for some rule are
rejected. The verdict goes back to the documents: a document stays when it passes the base rules
itself and its host is not rejected.

Defined results: a null or blank text has no words, all counts are 0 and it fails as too short; a
document without host (null) is judged by the base rules alone and takes no part in the prior;
repeated rows are counted as often as they occur and all come back; an empty table gives an empty
result; other columns are never looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import SPACE_BYTES, utf8
from docquarry.session import broadcast_if_small, materialise

WINDOW_WORDS = 8
RULES = ("short", "repeated", "symbols", "lines")
MIN_PRIOR_WEIGHT = 10  # documents


@dataclass(frozen=True)
class HostRules:
    """Limits of the rules and of the host verdict."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: int = 50
    max_dup_line_percent: int = 50
    max_host_rate: float = 0.5


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_KIND = np.zeros(256, np.uint8)  # 1: begins a character of a word, 2: such a character that is also a symbol
_KIND[[b for b in range(256) if not 0x80 <= b < 0xC0 and b not in SPACE_BYTES]] = 1
_KIND[list(b"#*$%&|<>")] = 2


def _repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur at least twice in the text, overlaps included."""
    n = len(words) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for width in (1, 2, 4):
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]  # hash of windows twice as wide
    ranked = np.argsort(h, kind="stable")
    same = h[ranked[1:]] == h[ranked[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[ranked[1:][same]] = True
    hit[ranked[:-1][same]] = True
    # Equal hashes only nominate windows; the words themselves decide.
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(hit).tolist():
        seen.setdefault(tuple(words[i : i + WINDOW_WORDS]), []).append(i)
    edges = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            at = np.array(places)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + WINDOW_WORDS, -1)
    return int((np.cumsum(edges) > 0).sum())


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def _measures(texts: pa.Array) -> pa.Array:
    rows = []
    for text in utf8(texts):
        words = text.split()  # splits at ASCII white space only
        kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=3)
        lines = [line for line in text.split(b"\n") if line.strip()]
        rows.append((
            len(words), kinds[1] + kinds[2], kinds[2], len(lines), len(lines) - len(set(lines)), _repeated_words(words),
        ))
    flat = np.array(rows, np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(column) for column in flat.T], list(MEASURES))


def measures(text: Column) -> Column:
    """A struct of counts over the whole text; see ``MEASURES``."""
    return _measures(text)


def rule_failures(m: Column, rules: HostRules = HostRules()) -> Column:
    """A struct of one boolean per rule of ``RULES``."""
    return F.struct(
        (m["n_words"] < rules.min_words).alias("short"),
        (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"]).alias("repeated"),
        (100 * m["n_symbols"] > rules.max_symbol_percent * m["word_chars"]).alias("symbols"),
        (100 * m["n_dup_lines"] > rules.max_dup_line_percent * m["n_lines"]).alias("lines"),
    )


def base_failed(failures: Column) -> Column:
    return failures["short"] | failures["repeated"]


def host_rates(measured: DataFrame, host: str = "host", m: str = "m", rules: HostRules = HostRules()) -> DataFrame:
    """Documents and failures per host and rule, and the shrunk rates: one row per host.

    The prior is a beta distribution per rule, fitted by moments over all hosts: mean m = sum f / sum n,
    and the correlation rho within hosts from Q = sum n (f/n - m)^2 / (m (1 - m)), whose expectation is
    (K - 1) + rho * sum (n - 1)(1 - n / N). Its weight in documents is (1 - rho) / rho.
    """
    failed = rule_failures(F.col(m), rules)
    counts = materialise(
        measured.filter(F.col(host).isNotNull()).groupBy(host).agg(
            F.count("*").alias("n"), *[F.sum(failed[r].cast("long")).alias(f"f_{r}") for r in RULES]
        ),
        "host-counts",
    )
    totals = counts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), *[F.sum(f"f_{r}").alias(r) for r in RULES]).first()
    if not totals["k"]:
        return counts.select("*", *[F.lit(0.0).alias(f"rate_{r}") for r in RULES])
    means = {r: totals[r] / totals["n"] for r in RULES}
    n = F.col("n")
    spread = counts.agg(
        F.sum((n - 1) * (1 - n / F.lit(float(totals["n"])))).alias("room"),
        *[F.sum(n * F.pow(F.col(f"f_{r}") / n - F.lit(means[r]), F.lit(2.0))).alias(r) for r in RULES],
    ).first()
    shrunk = []
    for r in RULES:
        mean = means[r]
        within = mean * (1 - mean)
        rho = (spread[r] / within - (totals["k"] - 1)) / spread["room"] if within > 0 and spread["room"] > 0 else 0.0
        rho = min(max(rho, 1e-6), 1 / (1 + MIN_PRIOR_WEIGHT))  # neither an infinite prior nor one that a few documents outweigh
        weight = (1 - rho) / rho
        shrunk.append(((F.col(f"f_{r}") + mean * weight) / (n + weight)).alias(f"rate_{r}"))
    return counts.select("*", *shrunk)


def rejected_hosts(rates: DataFrame, host: str = "host", rules: HostRules = HostRules()) -> DataFrame:
    """Hosts whose shrunk failure rate is above the limit for some rule."""
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    return rates.filter(worst > rules.max_host_rate).select(host)


def _judged(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """Left join of the host verdict; the rejected hosts are broadcast when counted and found small."""
    verdict = broadcast_if_small(rejected.select(F.col("host").alias("rejected_host")))
    return rows.join(verdict, rows["host"] == verdict["rejected_host"], "left")


def host_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: HostRules = HostRules()
) -> DataFrame:
    """One row per document: id, host, the measures, the rule failures, ``base_failed``, ``host_rejected``, ``kept``.

    Texts are read once; what is shuffled is one row per task and host.
    """
    measured = materialise(
        docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), measures(F.col(text_col)).alias("m")), "measures"
    )
    judged = _judged(measured, rejected_hosts(host_rates(measured, rules=rules), rules=rules))
    failures = rule_failures(F.col("m"), rules)
    base = base_failed(failures)
    bad_host = F.col("rejected_host").isNotNull()
    return judged.select(
        F.col("id").alias(id_col), F.col("host").alias(host_col), "m.*",
        *[failures[r].alias(f"fails_{r}") for r in RULES],
        base.alias("base_failed"), bad_host.alias("host_rejected"), (~base & ~bad_host).alias("kept"),
    )


def keep_good(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", rules: HostRules = HostRules()
) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Texts are read and measured twice instead of being shuffled or stored.
    """
    rows = docs.select(
        F.struct("*").alias("row"), F.col(host_col).alias("host"), measures(F.col(text_col)).alias("m")
    )
    rejected = materialise(rejected_hosts(host_rates(rows.select("host", "m"), rules=rules), rules=rules), "rejected-hosts")
    judged = _judged(rows, rejected)
    return judged.filter(F.col("rejected_host").isNull() & ~base_failed(rule_failures(F.col("m"), rules))).select("row.*")
