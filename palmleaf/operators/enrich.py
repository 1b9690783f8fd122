"""Book metadata: dimension joins with defaults, injected enrichment of misses, template projections."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.config import META_KEYS, NOT_AVAILABLE
from palmleaf.functions.text import match_key_a, match_key_b
from palmleaf.operators.ledger import Ledger
from palmleaf.shared import fresh

_MAP = "map<string,string>"


def fill_template(meta: Column, keys: list[str] = META_KEYS, default: str = NOT_AVAILABLE) -> Column:
    """A map of exactly `keys`; missing and null values become the default, as data. A null map is all defaults."""
    full = F.coalesce(meta, F.create_map().cast(_MAP))
    return F.create_map(*[x for k in keys for x in (F.lit(k), F.coalesce(F.try_element_at(full, F.lit(k)), F.lit(default)))])


def overlay(meta: Column, changes: dict[str, Column]) -> Column:
    """The map with some keys set anew."""
    names = list(changes)
    kept = F.map_filter(meta, lambda k, _: ~k.isin(names))
    return F.map_concat(kept, F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), v.cast("string"))]))


def with_metadata(rows: DataFrame, name_col: str, index: DataFrame, key: Callable[[Column], Column] = match_key_b, out: str = "metadata", keys: list[str] = META_KEYS) -> DataFrame:
    """Left join of names to the index (name, meta) by match key; misses get the template's defaults.

    Spark broadcasts the index where its size is below the session's threshold. Names of the index that share a key are
    one entry, that of the greatest name.
    """
    name, found = fresh(rows, "key"), fresh(rows, "meta")
    dim = index.select(key(F.col("name")).alias(name), "name", "meta").groupBy(name).agg(F.max_by("meta", "name").alias(found))
    joined = rows.withColumn(name, key(F.col(name_col))).join(dim, name, "left")
    return joined.withColumn(out, fill_template(F.col(found), keys)).drop(name, found)


def enrich_misses(rows: DataFrame, name_col: str, cache: DataFrame, enrich_fn: Callable[[str], dict | None], key: Callable[[Column], Column] = match_key_a, per_minute: float | None = None, workers: int = 4) -> DataFrame:
    """The cache (name, meta) with an entry for each name of `rows` that it lacks.

    Distinct misses only reach `enrich_fn`, in batches on the executors; what fails or is no mapping gets the template's
    defaults. The result replaces the cache. With `per_minute` the misses are dealt to `workers` tasks, each of which calls at
    its share of that rate, so all together never exceed it.
    """
    known = cache.select(key(F.col("name")).alias("__key")).distinct()
    names = rows.select(F.col(name_col).alias("name")).where("name is not null").withColumn("__key", key(F.col("name")))
    misses = names.groupBy("__key").agg(F.min("name").alias("name")).join(known, "__key", "left_anti").select("name")

    if per_minute is not None:
        misses = misses.repartition(workers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = enrich_fn if per_minute is None else throttled(enrich_fn, per_minute / workers)
        for pdf in batches:
            out = []
            for name in pdf["name"]:
                try:
                    got = ask(name)
                except Exception:  # a failing service is a miss, as an unknown book is
                    got = None
                got = got if isinstance(got, dict) else {}
                out.append({k: str(got.get(k) or NOT_AVAILABLE) for k in META_KEYS})
            yield pd.DataFrame({"name": pdf["name"], "meta": out})

    return cache.select("name", "meta").unionByName(misses.mapInPandas(run, f"name string, meta {_MAP}"))


def enrich_once(rows: DataFrame, name_col: str, cache: DataFrame, enrich_fn: Callable[[str], dict | None], ledger: Ledger, key: Callable[[Column], Column] = match_key_a, per_minute: float | None = None, workers: int = 4) -> DataFrame:
    """As `enrich_misses`, but through a ledger: a name is asked for once, whatever fails on the way; a failed call gives defaults now and
    is tried again next time."""
    known = cache.select(key(F.col("name")).alias("key")).distinct()
    misses = rows.select(F.col(name_col).alias("name")).where("name is not null").groupBy(key(F.col("name")).alias("key")).agg(F.min("name").alias("name")).join(known, "key", "left_anti")
    asked = misses.select(ledger.key(F.col("key"), "enrich").alias("key"), "name")
    got = ledger.ask(asked.select("key", F.col("name").alias("prompt")), lambda n: json.dumps(x) if isinstance(x := enrich_fn(n), dict) else None, per_minute, workers)
    # blank values are missing ones
    found = F.map_filter(F.from_json("answer", _MAP), lambda _, v: v.isNotNull() & (v != ""))
    return cache.select("name", "meta").unionByName(asked.join(got, "key", "left").select("name", fill_template(found).alias("meta")))


def throttled(fn: Callable, per_minute: float) -> Callable:
    """`fn`, called at most so often a minute by each worker; give it to `enrich_misses` or `answered` as their function."""
    last = [0.0]

    def call(x):
        time.sleep(max(0.0, last[0] + 60 / per_minute - time.monotonic()))
        last[0] = time.monotonic()
        return fn(x)

    return call


def scalar_metadata(meta: Column, last_updated: Column | None = None) -> Column:
    """Non-null entries only, with `last_updated` as text."""
    kept = F.map_filter(meta, lambda _, v: v.isNotNull())
    return kept if last_updated is None else overlay(kept, {"last_updated": last_updated})
