"""The ledger of calls: no prompt is asked twice, whatever fails, and the rate holds."""

import os
import time

import pytest
from pyspark.sql import functions as F

from palmleaf.operators import answer as A
from palmleaf.operators import enrich
from palmleaf.operators.ledger import Ledger


def counting(folder, fail_at=None):
    """A model that notes every call in a file, and once ends the task that makes the call number `fail_at`."""

    def reply(prompt):
        with open(f"{folder}/calls", "a") as f:
            f.write(f"{time.time()} {prompt}\n")
        with open(f"{folder}/calls") as f:
            n = len(f.readlines())
        if fail_at is not None and n >= fail_at and not os.path.exists(f"{folder}/failed"):
            open(f"{folder}/failed", "w").close()
            raise SystemExit("killed as a worker would be, past the handling of failed calls")
        if prompt == "bad":
            raise ValueError("no answer")
        return None if prompt == "none" else f"said {prompt}"

    return reply


def calls(folder):
    with open(f"{folder}/calls") as f:
        return [line.split(" ", 1)[1].strip() for line in f]


def asked(spark, prompts):
    return spark.createDataFrame([(p,) for p in prompts], "prompt string").select(Ledger.key(F.col("prompt")).alias("key"), "prompt")


@pytest.mark.parametrize("batch", [1, 4])
def test_a_task_that_fails_half_way(spark, tmp_path, batch):
    prompts = [f"p{k}" for k in range(30)] * 2
    ledger = Ledger(spark, str(tmp_path / "ledger"), batch)
    with pytest.raises(Exception, match="(?i)killed|crashed|aborted|exited"):
        ledger.ask(asked(spark, prompts), counting(tmp_path, fail_at=13), workers=2)
    before = calls(tmp_path)
    assert 13 <= len(before) < 30 and ledger.answers().count() >= len(before) - 2 * batch
    got = ledger.ask(asked(spark, prompts), counting(tmp_path, fail_at=13), workers=2).collect()
    assert {r["answer"] for r in got} == {f"said p{k}" for k in range(30)} and len(got) == 30
    # the call that was cut off has no answer, so it alone may be made again; another task may have been ended with it
    again = [p for p in set(calls(tmp_path)) if calls(tmp_path).count(p) > 1]
    assert len(again) <= 2 and len(calls(tmp_path)) <= 32
    n = len(calls(tmp_path))
    assert ledger.ask(asked(spark, prompts[:7]), counting(tmp_path)).count() == 7 and len(calls(tmp_path)) == n


def test_failed_calls_and_rate(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    df = asked(spark, ["a", "bad", "none", "b", "c", "d"]).unionByName(spark.createDataFrame([(None, "x")], "key string, prompt string"))
    began = time.time()
    got = {(r["answer"], r["error"]) for r in ledger.ask(df, counting(tmp_path), per_minute=120, workers=3).collect()}
    assert got == {("said a", None), (None, "no answer"), (None, None), ("said b", None), ("said c", None), ("said d", None)}
    stamps = sorted(float(x.split(" ")[0]) for x in open(f"{tmp_path}/calls"))
    # at 120 a minute no second sees more than three calls, whatever the tasks do
    assert all(stamps[k + 4] - stamps[k] >= 1 for k in range(len(stamps) - 4)) and time.time() - began > 1.5
    ledger.ask(df, counting(tmp_path)).count()
    assert sorted(calls(tmp_path)) == ["a", "b", "bad", "bad", "c", "d", "none"]


def test_answers_and_enrichment_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([(1, "q"), (2, "q"), (3, "bad"), (4, "none"), (5, None)], "key int, prompt string")
    for _ in range(2):
        got = {r["key"]: r["answer"] for r in A.answered_once(rows, ledger, counting(tmp_path)).collect()}
        assert got == {1: "said q", 2: "said q", 3: A.P.ERROR_PREFIX + "no answer", 4: A.P.NO_INFO, 5: A.P.NO_INFO}
    assert sorted(calls(tmp_path)) == ["bad", "bad", "none", "q"]
    books = spark.createDataFrame([("Book a",), ("book-A",), ("b",), ("c",), (None,)], "book string")
    cache = spark.createDataFrame([("B", {"STT": "0"})], "name string, meta map<string,string>")
    note = counting(tmp_path)

    def look_up(name):
        note(name)
        return {"STT": "7", "Bộ": ""} if name.startswith("B") else None

    for _ in range(2):
        got = {r["name"]: r["meta"] for r in enrich.enrich_once(books, "book", cache, look_up, ledger).collect()}
        assert set(got) == {"B", "Book a", "c"} and got["Book a"]["STT"] == "7" and got["Book a"]["Bộ"] == enrich.NOT_AVAILABLE and got["c"]["STT"] == enrich.NOT_AVAILABLE
    assert sorted(calls(tmp_path)[4:]) == ["Book a", "c"]


def test_no_prompts(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.answers().count() == 0 and ledger.ask(asked(spark, []), counting(tmp_path)).count() == 0
