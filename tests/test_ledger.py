import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftgate.operators import checks, judge, ledger, replay


def counting(log, fails=(), dies=()):
    """A provider that notes each finished call in a folder; some prompts fail, some end the worker."""

    class Provider:
        def complete(self, case_id, prompt):
            if prompt in dies and not os.path.exists(f"{log}/died-{prompt}"):
                open(f"{log}/died-{prompt}", "w").close()
                os._exit(1)
            if prompt in fails:
                raise RuntimeError(f"no {prompt}")
            with open(f"{log}/{prompt}-{os.getpid()}-{os.urandom(4).hex()}", "w"):
                pass
            return prompt.upper()

    return Provider


def made(log):
    return sorted(n.split("-")[0] for n in os.listdir(log) if not n.startswith("died"))


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log")


def cases(spark, *prompts):
    return spark.createDataFrame([(str(k), p) for k, p in enumerate(prompts)], "case_id string, prompt string")


def answers(frame):
    return {r.case_id: r.cand_text or r.error for r in frame.collect()}


def test_a_call_is_made_once_whatever_asks_for_it(spark, tmp_path, log):
    path = str(tmp_path / "ledger")
    first = ledger.call(cases(spark, "a", "b", "a"), counting(log), "m", path, buckets=4)
    assert answers(first) == {"0": "A", "1": "B", "2": "A"} and made(log) == ["a", "b"]
    more = ledger.call(cases(spark, "b", "c"), counting(log), "m", "file://" + path, buckets=4)
    assert answers(more) == {"0": "B", "1": "C"} and made(log) == ["a", "b", "c"]
    # another model is another call
    ledger.call(cases(spark, "a"), counting(log), "other", path, buckets=4)
    assert made(log) == ["a", "a", "b", "c"]
    ledger.compact(spark, path, str(tmp_path / "small"))
    assert answers(ledger.call(cases(spark, "c"), counting(log), "m", str(tmp_path / "small"))) == {"0": "C"} and len(made(log)) == 4


def test_errors_are_rows_and_are_tried_again_by_the_next_run(spark, tmp_path, log):
    path = str(tmp_path / "ledger")
    got = answers(ledger.call(cases(spark, "a", "b"), counting(log, fails=("b",)), "m", path))
    assert got == {"0": "A", "1": "RuntimeError: no b"}
    assert answers(ledger.call(cases(spark, "a", "b"), counting(log), "m", path)) == {"0": "A", "1": "B"} and made(log) == ["a", "b"]


def test_a_worker_that_dies_loses_no_finished_call(spark, tmp_path, log):
    path, prompts = str(tmp_path / "ledger"), [f"p{k:02d}" for k in range(30)]
    with pytest.raises(Exception, match="(?i)worker|crashed|exited"):
        ledger.call(cases(spark, *prompts), counting(log, dies=("p17",)), "m", path, buckets=2)
    before = made(log)
    assert before and "p17" not in before
    assert set(answers(ledger.call(cases(spark, *prompts), counting(log), "m", path, buckets=2)).values()) == {p.upper() for p in prompts}
    assert made(log) == prompts


def test_a_repeated_task_reads_what_it_has_written(tmp_path, log):
    keys = [f"k{k}" for k in range(9)]
    rows = pa.RecordBatch.from_arrays([pa.array([0] * 9, pa.int32()), pa.array(keys), pa.array(keys)], names=["bucket", "key", "prompt"])
    work = lambda provider: ledger._calls(str(tmp_path / "l"), "run1", "m", provider, 1, None, 1, 0, 0, 0)(iter([rows]))

    class Lost(BaseException):
        pass

    class Breaks(counting(log)):
        def complete(self, case_id, prompt):
            if prompt == "k5":
                raise Lost
            return super().complete(case_id, prompt)

    with pytest.raises(Lost):
        list(work(Breaks))
    assert made(log) == keys[:5]
    assert list(work(counting(log)))[0].to_pylist() == [{"made": 4, "read": 5}] and made(log) == keys


def test_tokens_are_given_out_at_the_rate():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    bucket = ledger.TokenBucket(2.0, 3, lambda: now[0], sleep)
    [bucket.take() for _ in range(3)]
    assert slept == []
    [bucket.take() for _ in range(4)]
    assert slept == [0.5] * 4
    now[0] += 100
    [bucket.take() for _ in range(3)]
    assert len(slept) == 4


def test_a_retry_takes_a_token_too():
    taken, client = [], replay.Scripted(fail_times=2)
    assert replay.attempt(client, "a", "x", 2, 0, 0, lambda: taken.append(1))[:3] == ("x", None, 3) and len(taken) == 2


def test_judge_settles_open_cases_only(spark, tmp_path, log):
    rows = [("same", "q", "a b", "a  b"), ("open", "q", "a b", "b a"), ("mute", "q", "a b", "c d"), ("down", "q", "a b", "zzz"), ("gone", "q", "a b", None)]
    checked = checks.evaluate(spark.createDataFrame(rows, "case_id string, prompt string, base_text string, cand_text string"), json=False)

    class Judge:
        def complete(self, case_id, prompt):
            open(f"{log}/call-{os.urandom(4).hex()}", "w").close()
            if "zzz" in prompt:
                raise RuntimeError("down")
            return '{"verdict": "acceptable", "confidence": 0.8, "rationale": "fine"}' if "b a" in prompt else "no idea"

    path = str(tmp_path / "ledger")
    got = {r.case_id: (r.verdict, r.judge_note) for r in judge.judged(checked, lambda: Judge(), "m", path).select("case_id", "verdict", F.col("judge_note")).collect()}
    assert got == {"same": ("equivalent", None), "open": ("acceptable", "fine"), "mute": ("unverified", "judge gave no verdict"), "down": ("unverified", "judge unavailable: RuntimeError: down"), "gone": ("error", None)}
    assert len(made(log)) == 3
