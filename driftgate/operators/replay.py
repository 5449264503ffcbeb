"""Replay: candidates from a provider, one call a case, with bounded retries inside the task.

Where a call is paid for and must not be repeated, ``ledger.call`` keeps its result; otherwise write the result before
branching from it, and take the cases that are still missing by ``remaining``. Concurrency is the number of partitions.
"""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Transient(Exception):
    """A failure that may pass; any other exception is final for its case."""


class Provider(Protocol):
    def complete(self, case_id: str, prompt: str) -> str: ...


class Scripted:
    """A provider without a model: replies by case id, else the prompt itself; the first ``fail_times`` calls of a case fail."""

    def __init__(self, replies: dict[str, str] | None = None, fail_times: int = 0):
        self.replies, self.fail_times, self.calls = replies or {}, fail_times, {}

    def complete(self, case_id: str, prompt: str) -> str:
        self.calls[case_id] = self.calls.get(case_id, 0) + 1
        if self.calls[case_id] <= self.fail_times:
            raise Transient(f"scripted failure {self.calls[case_id]}")
        return self.replies.get(case_id, prompt)


SCHEMA = "case_id string, cand_text string, cand_finish string, error string, attempts int, duration_ms long"


def delays(attempts: int, base: float, cap: float, seed: int) -> Iterator[float]:
    """Full jitter under an exponential bound."""
    rng = random.Random(seed)
    for k in range(attempts):
        yield rng.uniform(0, min(cap, base * 2**k))


def attempt(client: Provider, case_id: str, prompt: str, retries: int, base: float, cap: float, before_retry: Callable[[], None] | None = None) -> tuple[str | None, str | None, int, int]:
    """Reply, error, attempts and milliseconds of one case; a transient failure is tried again."""
    began = time.monotonic()
    waits, text, error, tried = delays(retries, base, cap, zlib.crc32(str(case_id).encode())), None, None, 0
    while True:
        tried += 1
        try:
            text, error = client.complete(case_id, prompt), None
        except Transient as e:
            error = str(e)
            if (wait := next(waits, None)) is not None:
                time.sleep(wait)
                if before_retry:
                    before_retry()
                continue
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
        return text, error, tried, int(1000 * (time.monotonic() - began))


def replay(cases: DataFrame, provider: Callable[[], Provider], retries: int = 2, base: float = 1.0, cap: float = 30.0) -> DataFrame:
    """case_id, cand_text, cand_finish, error, attempts, duration_ms of cases (case_id, prompt); errors are rows, never failures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = provider()
        for batch in batches:
            rows = []
            for case_id, prompt in zip(batch["case_id"], batch["prompt"], strict=True):
                text, error, tried, took = attempt(client, case_id, prompt, retries, base, cap)
                rows.append((case_id, text, None if text is None else "stop", error, tried, took))
            yield pd.DataFrame(rows, columns=["case_id", "cand_text", "cand_finish", "error", "attempts", "duration_ms"])

    return cases.select("case_id", "prompt").mapInPandas(run, SCHEMA)


def remaining(cases: DataFrame, done: DataFrame) -> DataFrame:
    """Cases without a result yet, to resume a run."""
    return cases.join(done.select("case_id"), "case_id", "left_anti")


def paired(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every case beside its candidate; a case without one has none and becomes an error."""
    return cases.drop("cand_text", "cand_finish", "error").join(candidates.select("case_id", "cand_text", "cand_finish", "error"), "case_id", "left")
