"""Batch generation over assembled prompts by a plug-in callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as OutOfTime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A generator factory is called once per task and returns a function (prompts, temperature) -> texts.
GeneratorFactory = Callable[[], Callable[[list[str], float], list[str]]]
DEFAULT_TEMPERATURE = 0.001
DEFAULT_BUDGET = 8192


def token_batches(prompts: list[str], budget: int) -> Iterator[list[int]]:
    """Places of the prompts by rising number of whitespace tokens, in batches whose padded size stays within ``budget``.

    A prompt larger than that is a batch of its own.
    """
    sizes = [max(1, len(p.split())) for p in prompts]
    held: list[int] = []
    for place in sorted(range(len(prompts)), key=lambda i: (sizes[i], i)):
        if held and sizes[place] * (len(held) + 1) > budget:
            yield held
            held = []
        held.append(place)
    if held:
        yield held


class _Caller:
    """Calls a model with one batch; an exception, a wrong number of texts or too long a wait is an error text."""

    def __init__(self, model, temperature: float, timeout: float | None):
        self.model, self.temperature, self.timeout = model, temperature, timeout
        self.pool = ThreadPoolExecutor(1)

    def call(self, prompts: list[str]) -> tuple[list[str] | None, str | None]:
        try:
            texts = list(self.pool.submit(self.model, prompts, self.temperature).result(self.timeout))
        except OutOfTime:
            self.pool = ThreadPoolExecutor(1)  # the one before is still busy with the call that was given up
            return None, "timeout"
        except Exception as failure:  # noqa: BLE001 - whatever a model raises belongs to its rows
            return None, f"{type(failure).__name__}: {failure}"
        if len(texts) != len(prompts):
            return None, f"{len(texts)} texts for {len(prompts)} prompts"
        return texts, None


def generate(
    df: DataFrame, generator: GeneratorFactory, prompt: str = "prompt", output: str = "response",
    temperature: float = DEFAULT_TEMPERATURE, error: str | None = None, budget: int = DEFAULT_BUDGET, timeout: float | None = None,
) -> DataFrame:
    """Adds a response per prompt, in the rows' own order. No model is bundled.

    The model is called with batches of prompts of similar length within a budget of tokens. With ``error`` (the
    name of a column) a batch that fails or takes longer than ``timeout`` seconds is tried again row by row; a row that
    fails alone has a null response and the reason in that column. Without it the task fails. Null prompts have
    neither response nor error.
    """

    @F.pandas_udf("response string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        caller = _Caller(generator(), temperature, timeout)
        for batch in batches:
            rows = [i for i, p in enumerate(batch) if p is not None]
            prompts = [batch.iloc[i] for i in rows]
            texts, reasons = [None] * len(batch), [None] * len(batch)
            for places in token_batches(prompts, budget):
                made, reason = caller.call([prompts[p] for p in places])
                if reason is not None and error is None:
                    raise RuntimeError(reason)
                alone = [caller.call([prompts[p]]) for p in places] if reason is not None and len(places) > 1 else [(made, reason)]
                if len(alone) == len(places):
                    made = [m[0] if m else None for m, _ in alone]
                for at, p in enumerate(places):
                    texts[rows[p]] = made[at] if made else None
                    reasons[rows[p]] = alone[at][1] if len(alone) == len(places) else None
            yield pd.DataFrame({"response": pd.Series(texts, dtype=object), "error": pd.Series(reasons, dtype=object)})

    made = df.withColumn("__made", run(F.col(prompt))).withColumn(output, F.col("__made.response"))
    return (made if error is None else made.withColumn(error, F.col("__made.error"))).drop("__made")
