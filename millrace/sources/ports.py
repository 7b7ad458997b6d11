"""Model calls behind a port: batches of prompts in, texts out.  The stub answers from the prompt alone."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ModelPort(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


def stub(prompts: list[str]) -> list[str]:
    """A deterministic model: it waits on short prompts and answers long ones."""
    return [f"<ANSWER> {len(p)} signs" if len(p or "") > 500 else "<WAIT> more context is needed" for p in prompts]


# Tries, first wait, growth of waits and the wait after a limit, in seconds; words that name a limit.
RETRIES, DELAY, GROWTH, LIMITED = 3, 8.0, 1.6, 60.0
LIMIT_WORDS = ("429", "rate", "quota")


def wait_seconds(attempt: int, error: Exception) -> float:
    """How long to wait before try ``attempt`` (from 1) after ``error``."""
    text = str(error).lower()
    return LIMITED if any(w in text for w in LIMIT_WORDS) else DELAY * GROWTH ** (attempt - 1)


def retrying(call: ModelPort, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> ModelPort:
    """The port, asked again after a failure or an answer that isn't there (null), ``retries`` times at most."""

    def ask_again(prompts: list[str]) -> list[str]:
        for attempt in range(1, retries + 2):
            try:
                texts = call(prompts)
                if any(t is None for t in texts):
                    raise ValueError("no answer")
                return texts
            except Exception as e:
                if attempt > retries:
                    raise
                sleep(wait_seconds(attempt, e))
        raise AssertionError

    return ask_again


def _one_by_one(call: ModelPort, prompts: list[str]) -> tuple[list[str | None], list[str | None]]:
    """Texts and errors of a batch that failed as a whole: only the prompts at fault stay without a text."""
    texts, errors = [], []
    for p in prompts:
        try:
            texts.append(call([p])[0])
            errors.append(None)
        except Exception as e:  # whatever a model raises is this row's result
            texts.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return texts, errors


def ask(rows: DataFrame, prompt: str, model: Callable[[], ModelPort], out: str = "response", error: str | None = None, retries: int = 0) -> DataFrame:
    """Add the model's text to each row; ``model()`` is made once a task.  Put filters before the call.

    A failing call is repeated ``retries`` times, with growing waits.  One that fails still fails the job, unless
    ``error`` names a column: then its prompts are asked singly, and those that fail again have no text and say why
    there.
    """
    added = [out] if error is None else [out, error]
    rows = rows.drop(*added)
    shape = rows.withColumns({c: F.lit(None).cast("string") for c in added}).schema
    at = rows.columns.index(prompt)

    def run(batches: Iterator):
        import pyarrow as pa

        call = retrying(model(), retries) if retries else model()
        for batch in batches:
            prompts = batch.column(at).to_pylist()
            try:
                texts, errors = call(prompts), [None] * len(prompts)
            except Exception:
                if error is None:
                    raise
                texts, errors = _one_by_one(call, prompts)
            more = [pa.array(x, pa.string()) for x in (texts, errors)[: len(added)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *added])

    return rows.mapInArrow(run, shape)


def backoff(attempt: Column, limited: Column) -> Column:
    """``wait_seconds`` as a column."""
    return F.when(limited, F.lit(LIMITED)).otherwise(F.lit(DELAY) * F.pow(F.lit(GROWTH), attempt - 1))


def crawl_wait(attempt: Column, jitter: Column) -> Column:
    """Seconds before a crawl is tried again: twice the attempt, 8 at most, and a jitter of 0.2 to 0.8."""
    return F.least(2 * attempt, F.lit(8)) + F.lit(0.2) + jitter * F.lit(0.6)


class MediaPort(Protocol):
    """What happens outside Spark with media, one call an item; every method may raise."""

    def search(self, target: str) -> list[dict]: ...
    def detail(self, url: str) -> dict | None: ...
    def frame(self, path: str, index: int) -> bytes | None: ...
    def transcript(self, path: str) -> list[dict]: ...
    def cut(self, path: str, start: float, end: float, out: str, reencode: bool) -> bool: ...
    def download(self, url: str, folder: str) -> str | None: ...


def each(rows: DataFrame, columns: list[str], call: Callable[[], Callable], kind: str, out: str = "result", error: str = "error") -> DataFrame:
    """Add ``out`` (a JSON text, null without a result) and ``error`` from one outside call a row.

    ``call()`` is made once a task and gets the row's ``columns``.  ``kind`` stands before an error's text.
    """
    rows = rows.drop(out, error)
    shape = rows.withColumns({c: F.lit(None).cast("string") for c in (out, error)}).schema
    at = [rows.columns.index(c) for c in columns]

    def run(batches: Iterator):
        import json

        import pyarrow as pa

        ask_one = call()
        for batch in batches:
            results, errors = [], []
            for values in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                try:
                    found = ask_one(*values)
                    results.append(None if found is None else json.dumps(found, ensure_ascii=False))
                    errors.append(None)
                except Exception as e:
                    results.append(None)
                    errors.append(f"{kind}: {type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, out, error])

    return rows.mapInArrow(run, shape)
