"""Writers: segment and document records, caches, versioned tables, normalised copies, counts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.config import NOT_AVAILABLE, UNKNOWN, WHOLE_DOCUMENT, Settings
from palmleaf.functions.text import match_key_a, nfc, safe_name, segment_name_v1, segment_name_v2
from palmleaf.operators.enrich import fill_template, overlay
from palmleaf.operators.segment import without_delimiter_lines


def segment_records_v1(segments: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(file_name, metadata, noi_dung) of strategy 1's segments with a `metadata` column; empty or untitled ones go."""
    lines = without_delimiter_lines(F.col("lines"), trailing_only=True)
    kept = segments.withColumn("noi_dung", lines).where((F.size("noi_dung") > 0) & (F.col("title") != UNKNOWN))
    base = F.translate(F.col("doc_id").cast("string"), " -", "__")
    return kept.select(
        segment_name_v1(base, F.col("chapter_no").cast("int"), F.col("number"), F.col("title"), settings.title_chars).alias("file_name"),
        overlay(F.col("metadata"), {"Tên Kinh Nhỏ": F.col("title"), "Số Phẩm": F.col("chapter_title"), "Chia Đoạn": F.col("label")}).alias("metadata"),
        "noi_dung",
    )


def segment_records_v2(segments: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(file_name, metadata, noi_dung) of strategy 2's segments with a `metadata` column; blank and delimiter lines go, empty segments too."""
    kept = segments.withColumn("noi_dung", without_delimiter_lines(F.col("lines"))).where(F.size("noi_dung") > 0)
    known = lambda c: F.when(F.col(c) != UNKNOWN, F.col(c)).otherwise(NOT_AVAILABLE)
    slug = lambda c: F.when(F.col(c) != UNKNOWN, F.left(match_key_a(F.col(c)), F.lit(settings.title_chars))).otherwise("")
    base = F.translate(F.col("doc_id").cast("string"), " ", "_")
    meta = overlay(F.col("metadata"), {"Tên Kinh Nhỏ": known("title"), "Số Phẩm": known("chapter_title"), "Chia Đoạn": F.col("label")})
    return kept.select(
        segment_name_v2(base, F.col("chapter_no"), slug("chapter_title"), F.col("number"), slug("title"), settings.name_chars).alias("file_name"), fill_template(meta).alias("metadata"), "noi_dung"
    )


def whole_document_records(documents: DataFrame) -> DataFrame:
    """(file_name, metadata, noi_dung_full_doc) of (doc_id, body, metadata)."""
    meta = overlay(F.col("metadata"), {"Tên Kinh Nhỏ": F.lit(NOT_AVAILABLE), "Số Phẩm": F.lit(NOT_AVAILABLE), "Chia Đoạn": F.lit(WHOLE_DOCUMENT)})
    return documents.select(F.concat(safe_name(F.translate(F.col("doc_id").cast("string"), " ", "_"), 200), F.lit(".json")).alias("file_name"), fill_template(meta).alias("metadata"), F.col("body").alias("noi_dung_full_doc"))


def write_records(records: DataFrame, path: str, as_json: bool = True) -> None:
    """Records as JSON lines or Parquet. Of records with one file name the last by content stays, as files overwrite each other."""
    rest = [c for c in records.columns if c != "file_name"]
    one = records.groupBy("file_name").agg(F.max_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("r")).select("file_name", "r.*")
    (one.write.mode("overwrite").json if as_json else one.write.mode("overwrite").parquet)(path)


def write_normalized(files: DataFrame, path: str) -> None:
    """The texts of (source_file, value) in normal form C, as a table."""
    files.select("source_file", nfc("value").alias("value")).write.mode("overwrite").parquet(path)


def write_cache(entries: DataFrame, path: str) -> None:
    VersionedTable(entries.sparkSession, path).replace(entries)


class VersionedTable:
    """A Parquet table of versions and changes: each version `v=` is a folder of its own, the newest complete one counts, and
    the changes `d=` made to it since are folders beside it, which readers lay over it.

    So a table can be read while its successor is computed from it, a failed write changes nothing, and a small change costs
    what it writes. `merge` writes a new version when the changes have become COMPACT_SHARE of it or COMPACT_FOLDERS folders.
    """

    COMPACT_SHARE, COMPACT_FOLDERS = 0.25, 50

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """Rows with an `id` are written in `buckets` buckets of it, sorted, so that versions, changes and sources meet without the
        table being shuffled, and a filter on a few ids reads their buckets only. Folders written with other numbers stay readable."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        return at, at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, rows: DataFrame, name: str) -> None:
        """Write a folder. A file in it says in how many buckets; it is made last, so a folder without it is read as it is."""
        folder = f"{self.path}/{name}"
        if dict(rows.dtypes).get("id") != "string":
            rows.write.mode("overwrite").parquet(folder)
            return
        name = f"palmleaf_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "id")
        dealt.write.mode("overwrite").format("parquet").option("path", folder).bucketBy(self.buckets, "id").sortBy("id").saveAsTable(name)
        self.spark.sql(f"drop table {name}")
        at, fs = self._fs()
        fs.create(at(f"{folder}/_buckets-{self.buckets}")).close()

    def _get(self, name: str) -> DataFrame:
        """A folder's rows, as a bucketed table where it was written as one."""
        folder = f"{self.path}/{name}"
        rows = self.spark.read.parquet(folder)
        at, fs = self._fs()
        buckets = [n for s in fs.listStatus(at(folder)) if (n := s.getPath().getName()).startswith("_buckets-")]
        if not buckets:
            return rows
        table, schema = f"palmleaf_{uuid.uuid4().hex}", rows._jdf.schema().toDDL()
        self.spark.sql(f"create table {table} ({schema}) using parquet clustered by (id) sorted by (id) into {buckets[0].split('-')[1]} buckets location '{folder}'")
        read = self.spark.table(table)
        # the plan has found its files; the name is no longer needed
        self.spark.sql(f"drop table {table}")
        return read

    def _complete(self, prefix: str) -> list[str]:
        """Names of the folders that begin with `prefix` and were written to their end, in order."""
        at, fs = self._fs()
        if not fs.exists(at(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at(self.path))]
        return sorted(n for n in names if n.startswith(prefix) and fs.exists(at(f"{self.path}/{n}/_SUCCESS")))

    def _versions(self) -> list[int]:
        return [int(n[2:]) for n in self._complete("v=")]

    def _changes(self, version: int) -> list[str]:
        return self._complete(f"d={version:09d}-")

    def read(self) -> DataFrame | None:
        """The newest version under its changes, or None. The changes meet the version in one anti-join, on id."""
        found = self._versions()
        if not found:
            return None
        base = self._get(f"v={found[-1]:09d}")
        newest = self._newest(found[-1])
        if newest is None:
            return base
        return base.join(newest.select("id"), "id", "left_anti").select(*base.columns).unionByName(newest.where("not __gone").select(*base.columns))

    def _newest(self, version: int, *cols: str) -> DataFrame | None:
        """The changes since a version, the last one for each id, all columns or id and some; `__gone` where the row went."""
        changes = self._changes(version)
        if not changes:
            return None
        some = lambda rows: rows.select("id", "__gone", *cols) if cols else rows
        rows = reduce(DataFrame.unionByName, [some(self._get(n)).withColumn("__no", F.lit(k)) for k, n in enumerate(changes)])
        return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "__no")]), "__no").alias("r")).select("id", "r.*")

    def current(self, ids: DataFrame, *cols: str, few: list[str] | None = None) -> DataFrame | None:
        """(id, cols) as they are now of those `ids` that the table has, or None where there is no table.

        The ids go to the buckets of the version and its changes; these aren't shuffled, and with `few`, a list of all these ids, only
        their buckets are read.
        """
        found = self._versions()
        if not found:
            return None
        cut = lambda rows: rows if few is None else rows.where(F.col("id").isin(few))
        base = cut(self._get(f"v={found[-1]:09d}").select("id", F.struct(*cols).alias("__base")))
        now = ids.select("id").join(base, "id", "left")
        newest = self._newest(found[-1], *cols)
        if newest is not None:
            now = now.join(cut(newest.select("id", F.struct("__gone", *cols).alias("__over"))), "id", "left")
            # a row that went is no row, one that came or changed is the newer one
            over, under = F.col("__over"), F.col("__base")
            row = F.when(over.isNull(), under).when(~over["__gone"], F.struct(*[over[c].alias(c) for c in cols]))
            now = now.select("id", row.alias("__base"))
        return now.where("__base is not null").select("id", *[F.col(f"__base.{c}").alias(c) for c in cols])

    def merge(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Rows that replace those of their `id` or are new, one an id, and the `id`s in `gone` that go. An empty table becomes `rows`."""
        found = self._versions()
        if not found:
            return self.replace(rows)
        marked = rows.withColumn("__gone", F.lit(False))
        if gone is not None:
            marked = marked.unionByName(gone.select("id", F.lit(True).alias("__gone")), allowMissingColumns=True)
        before = self._changes(found[-1])
        number = int(before[-1].split("-")[1]) + 1 if before else 1
        self._put(marked, f"d={found[-1]:09d}-{number:09d}")
        changes = self._changes(found[-1])
        size = lambda names: self.spark.read.parquet(*[f"{self.path}/{n}" for n in names]).count()
        if len(changes) >= self.COMPACT_FOLDERS or size(changes) > self.COMPACT_SHARE * size([f"v={found[-1]:09d}"]):
            self.replace(self.read())

    def replace(self, rows: DataFrame) -> None:
        found = self._versions()
        self._put(rows, f"v={(found[-1] if found else 0) + 1:09d}")

    def set_aside(self, rows: DataFrame) -> DataFrame:
        """Rows written beside the versions and read again, so that they are worked out once; the next `vacuum` deletes them."""
        path = f"{self.path}/_aside-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest `keep` versions with their changes, and what was set aside."""
        at, fs = self._fs()
        old = self._versions()[:-keep]
        prefixes = ["_aside-", *[f"v={v:09d}" for v in old], *[f"d={v:09d}-" for v in old]]
        for s in fs.listStatus(at(self.path)):
            if s.getPath().getName().startswith(tuple(prefixes)):
                fs.delete(s.getPath(), True)


def counts(rows: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """Row counts by key with the grand total, where all keys are null."""
    return rows.rollup(*keys).agg(F.count(F.lit(1)).alias(out), F.grouping_id().alias("level"))
