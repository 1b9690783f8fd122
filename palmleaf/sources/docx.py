"""DOCX files as a data source: `spark.read.format("docx").load(folder)`, a partition for some files, and error rows."""

from __future__ import annotations

import io
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palmleaf.shared import store_of

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "doc_id string, para_no int, text string, error string"
#: What an unreadable file may raise: no archive, no such part, bad XML, a damaged or encrypted member.
BROKEN = (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError)
# The package's two small parts, and what the parts of a run stand for in plain text.
_TYPES = (
    '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
    'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)
_PLAIN = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def docx_paragraphs(data: bytes) -> list[str]:
    """The texts of the body's paragraphs, in order: of the runs directly in a paragraph or in its links their texts, tabs, breaks
    and hyphens. Properties, text boxes, deleted text, tables, headers and notes don't count."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p"):
        runs = [r for x in p for r in ([x] if x.tag == f"{_W}r" else x.findall(f"{_W}r") if x.tag == f"{_W}hyperlink" else [])]
        out.append("".join((x.text or "") if x.tag == f"{_W}t" else _PLAIN.get(x.tag, "") for r in runs for x in r))
    return out


def docx_bytes(paragraphs: list[str]) -> bytes:
    """A DOCX file of plain paragraphs; tabs and line breaks become elements, what XML can't hold is left out."""

    def run(text: str) -> str:
        held = "".join(c for c in text if c in "\t\n" or c >= " " and c not in "\ufffe\uffff")
        parts = re.split("([\t\n])", held)
        return "".join({"\t": "<w:tab/>", "\n": "<w:br/>"}.get(x) or f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in parts if x)

    body = "".join(f"<w:p><w:r>{run(p)}</w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def paragraph_rows(doc: str, data: bytes) -> list[tuple]:
    """(doc_id, para_no, text, error) of a file; one that can't be read is a single row with its error."""
    try:
        return [(doc, k, t, None) for k, t in enumerate(docx_paragraphs(data))]
    except BROKEN as e:
        return [(doc, 0, None, f"{type(e).__name__}: {e}")]


@dataclass
class Files(InputPartition):
    paths: list[str]


class DocxSource(DataSource):
    """Paragraphs (doc_id, para_no, text, error) of the DOCX files of a folder; doc_id is a file's name without its ending.

    Options: `path`, the folder, on any file system that pyarrow opens, seen by driver and executors alike; `ignoreCase` (false) takes
    endings in any case; `filesPerPartition` (64). Listing reads no contents, and a partition's files are opened by its task. For stores that only Spark opens
    there is `readers.read_docx`, with the same rows.
    """

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DocxReader(self.options)


class DocxReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options.get("path") or ""
        self.any_case = options.get("ignoreCase", "false").lower() == "true"
        self.each = max(1, int(options.get("filesPerPartition", "64")))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, folder = store_of(self.folder)
        fits = lambda name: (name.lower() if self.any_case else name).endswith(".docx") and not name.startswith((".", "_"))
        paths = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fits(f.base_name))
        return [Files(paths[k : k + self.each]) for k in range(0, len(paths), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = store_of(self.folder)
        for path in partition.paths:
            doc = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            try:
                with store.open_input_stream(path) as f:
                    data = f.read()
            except OSError as e:
                yield (doc, 0, None, f"{type(e).__name__}: {e}")
                continue
            yield from paragraph_rows(doc, data)


def register(spark: SparkSession) -> None:
    """Make `spark.read.format("docx")` known to a session."""
    spark.dataSource.register(DocxSource)


def write_docx(paragraphs: DataFrame, folder: str) -> int:
    """A DOCX file for each doc_id of (doc_id, para_no, text), written by the executors into a folder that all of them share; returns
    how many. A file appears whole or not at all, and a task that is run again writes the same one. Null texts are empty."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("para_no", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"])
    books = paragraphs.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(lines.alias("lines"))
    store_of(folder)[0].create_dir(store_of(folder)[1], recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = store_of(folder)
        for pdf in batches:
            for doc, texts in zip(pdf["doc_id"], pdf["lines"], strict=True):
                spare = f"{path}/_{uuid.uuid4().hex}"
                with store.open_output_stream(spare) as f:
                    f.write(docx_bytes(list(texts)))
                store.move(spare, f"{path}/{doc}.docx")
            yield pd.DataFrame({"n": [len(pdf)]})

    return books.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
