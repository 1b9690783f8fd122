"""A ledger of calls to models: every prompt has a key, what was answered is written down at once, and nothing is asked twice."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.shared import materialize, store_of

_ROW = pa.schema([("key", pa.string()), ("answer", pa.string())])
_SCHEMA = "key string, answer string"


def written(store, path: str) -> dict[str, str]:
    return dict(zip(*pq.read_table(path, filesystem=store, schema=_ROW).to_pydict().values(), strict=True))


class Ledger:
    """Answers under a folder that driver and executors share, on any file system that pyarrow opens.

    A task writes its answers in files of `batch` prompts, whose names come from the prompts' keys, under another name first. A task
    that is run again finds them and asks only for the rest; one that fails first writes down what it has. So a killed executor
    costs the calls of a batch at most, a failed call none. Failed calls are no answers and are tried again by the next `ask`.
    """

    def __init__(self, spark: SparkSession, path: str, batch: int = 20):
        self.spark, self.path, self.batch = spark, path.rstrip("/"), batch

    def answers(self) -> DataFrame:
        """(key, answer) of everything answered so far, one row a key."""
        try:
            rows = self.spark.read.schema(_SCHEMA).parquet(self.path)
            rows.isEmpty()
        except PySparkException:
            rows = self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy("key").agg(F.min("answer").alias("answer"))

    @staticmethod
    def key(prompt: Column, salt: str = "") -> Column:
        """The key of a prompt; `salt` tells models or settings apart."""
        return F.sha2(F.concat(F.lit(f"{salt}|"), prompt), 256)

    def ask(self, prompts: DataFrame, fn: Callable[[str], str | None], per_minute: float | None = None, workers: int = 4) -> DataFrame:
        """(key, answer, error) for each key of (key, prompt): from the ledger, or from `fn`, called once for each new key on the executors.

        A null answer counts as one. An exception of `fn` gives a null answer and its text as `error`. With `per_minute` the new prompts
        are dealt to `workers` tasks, and each waits its share before every call, the first too; so the rate holds however many of the
        tasks run at once, and when one is run again.
        """
        known = materialize(self.answers())
        asked = prompts.where("key is not null").groupBy("key").agg(F.min("prompt").alias("prompt"))
        new = materialize(asked.join(known.select("key"), "key", "left_anti"))
        path, batch, gap = self.path, self.batch, 60 * workers / per_minute if per_minute else 0.0
        store_of(path)[0].create_dir(store_of(path)[1], recursive=True)

        def answered(keys: list[str], texts: list[str], store, folder: str) -> list[tuple]:
            final = f"{folder}/{keys[0]}-{len(keys)}.parquet"
            first = written(store, final) if store.get_file_info(final).is_file else {}
            got, failed = dict(first), {}
            try:
                for key, text in zip(keys, texts, strict=True):
                    if key in got:
                        continue
                    time.sleep(gap)
                    try:
                        got[key] = fn(text)
                    except Exception as e:  # told to the caller, and asked again next time
                        failed[key] = str(e)
            finally:
                # whatever ends this task, paid answers are kept
                if len(got) > len(first):
                    spare = f"{folder}/_{uuid.uuid4().hex}"
                    pq.write_table(pa.table([list(got), [None if v is None else str(v) for v in got.values()]], schema=_ROW), spare, filesystem=store)
                    store.move(spare, final)
            return [(key, got.get(key), failed.get(key)) for key in keys]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            store, folder = store_of(path)
            for pdf in batches:
                keys, texts = pdf["key"].tolist(), pdf["prompt"].tolist()
                for k in range(0, len(keys), batch):
                    yield pd.DataFrame(answered(keys[k : k + batch], texts[k : k + batch], store, folder), columns=["key", "answer", "error"])

        # dealt and sorted by key, so that a task that is run again sees the same prompts in the same order
        dealt = new.repartition(workers, "key").sortWithinPartitions("key")
        fresh = materialize(dealt.mapInPandas(run, "key string, answer string, error string"))
        old = known.join(asked.select("key"), "key", "left_semi").select("key", "answer", F.lit(None).cast("string").alias("error"))
        return old.unionByName(fresh)
