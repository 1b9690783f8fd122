"""Content trees: pre-order flattening with inherited scalars, allowed types, first occurrences."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.config import NODE_TYPES
from palmleaf.shared import fresh

_NODES = "source_file string, pos long, type string, text string, metadata map<string,string>, error string"


def _scalar(value) -> str | None:
    return value if isinstance(value, str) or value is None else json.dumps(value)


def _walk(root) -> Iterator[tuple[dict, dict]]:
    """(node, scalars of it and its ancestors) in pre-order, with a stack of its own."""
    if isinstance(root, dict) and isinstance(root.get("Noi_Dung"), list):
        first = root["Noi_Dung"]
    else:
        first = root if isinstance(root, list) else [root]
    stack = [(n, {}) for n in reversed(first)]
    while stack:
        node, above = stack.pop()
        if not isinstance(node, dict):
            continue
        own = above | {k: _scalar(v) for k, v in node.items() if v is None or isinstance(v, str | int | float | bool)}
        yield node, own
        below = next((node[k] for k in ("content", "Noi_Dung") if isinstance(node.get(k), list)), [])
        stack += [(n, own) for n in reversed(below)]


def _segment(root: dict) -> Iterator[tuple[dict, dict]]:
    """A segment record as paragraph nodes that carry the record's metadata."""
    own = root.get("metadata") or {}
    if not isinstance(own, dict):
        raise ValueError("metadata is no object")
    above = {k: _scalar(v) for k, v in own.items() if v is None or isinstance(v, str | int | float | bool)}
    for line in root["noi_dung"]:
        yield {"type": "paragraph", "text": line}, above


def parse_trees(files: DataFrame) -> DataFrame:
    """All nodes of the JSON in (source_file, value), with pre-order position, text (`text`, else `tieu_de`) and inherited scalars.

    Roots may be an object with a list `Noi_Dung` (its own scalars are not inherited), another object, a list, or a segment record
    (metadata, noi_dung: list of texts). A file that can't be parsed, or whose text on an allowed type is no string, gives a
    single row with `error` set and no nodes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source_file", "pos", "type", "text", "metadata", "error"]
        for pdf in batches:
            for name, value in zip(pdf["source_file"], pdf["value"], strict=True):
                rows = []
                try:
                    root = json.loads(value)
                    if not isinstance(root, dict | list):
                        raise ValueError("the root is neither an object nor a list")
                    record = isinstance(root, dict) and isinstance(root.get("noi_dung"), list)
                    for node, scalars in _segment(root) if record else _walk(root):
                        text = node.get("text") or node.get("tieu_de")
                        if text and node.get("type") in NODE_TYPES and not isinstance(text, str):
                            raise ValueError("a text is not a string")
                        kind = node.get("type")
                        rows.append((name, len(rows), kind if isinstance(kind, str) else None, text if isinstance(text, str) else None, {"source_file": name} | scalars, None))
                except (ValueError, TypeError, RecursionError) as e:
                    rows = [(name, 0, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=names)

    return files.select("source_file", "value").mapInPandas(run, _NODES)


def flatten(files: DataFrame, types: list[str] = NODE_TYPES) -> DataFrame:
    """(source_file, pos, text, metadata) of the nodes of an allowed type whose stripped text is not blank."""
    from palmleaf.functions.text import strip

    nodes = parse_trees(files).where(F.col("error").isNull() & F.col("type").isin(types))
    return nodes.withColumn("text", strip(F.col("text"))).where("text <> ''").select("source_file", "pos", "text", "metadata")


def first_occurrences(rows: DataFrame, keys: tuple[str, ...] = ("source_file",), text_col: str = "text", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """The first row of each text within its keys."""
    name = fresh(rows, "rank")
    rank = F.row_number().over(Window.partitionBy(*keys, text_col).orderBy(*order))
    return rows.withColumn(name, rank).where(F.col(name) == 1).drop(name)


def chunk_id(file_col: str = "source_file", number: str = "doan_so", content: str = "content"):
    """An id that depends on a chunk's place and content only."""
    return F.sha2(F.concat_ws("|", F.col(file_col), F.col(number).cast("string"), F.col(content)), 256)
