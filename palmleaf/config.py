"""Settings, and the fixed values of the data model."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

# Fixed values of the data model: metadata keys in the order of the template, sentinel values, and allowed node types.
META_KEYS = [
    "STT", "Tên Tạng", "Bộ", "Tập Số (Đại Chánh)", "Số Hiệu (Đại Chánh)", "Việt Dịch (Số tập)",
    "Tên Kinh Đầy Đủ", "Tên Tiếng Hán", "Tên Kinh rút gọn", "Hán Dịch", "Việt Dịch",
    "Khảo Dịch - Hiệu đính", "Năm xuất bản", "Số Quyển", "Chủ đề chính", "Từ khóa liên quan", "ONIX tương ứng (gợi ý)", "Ghi chú",
    "Tên Kinh Nhỏ", "Số Phẩm", "Chia Đoạn",
]
NOT_AVAILABLE = "Not_Available"
UNKNOWN = "Không xác định"
WHOLE_DOCUMENT = "Toàn bộ tài liệu"
NODE_TYPES = ["van_xuoi", "paragraph", "tieu_de_pham", "tieu_de_chuong", "tieu_de_bai_kinh", "tụng"]
BY_CHAPTER_AND_SUTRA, BY_CHAPTER, BY_SUTRA = "Theo phẩm, theo kinh nhỏ", "Theo phẩm", "Theo kinh nhỏ"


@dataclass(frozen=True)
class Settings:
    """Typed settings. Each is read from the session (`palmleaf.<name>`), else the environment (PALMLEAF_<NAME>), else its default."""

    chunk_chars: int = 512
    top_k: int = 5
    batch_rows: int = 100
    answer_timeout_s: int = 90
    documents_per_minute: int = 30
    title_chars: int = 50
    name_chars: int = 200
    vector_table: str = ""

    @classmethod
    def load(cls, spark: SparkSession, required: tuple[str, ...] = ()) -> "Settings":
        """Settings of a session; a missing or blank `required` one is an error."""
        got = {}
        for f in fields(cls):
            raw = spark.conf.get(f"palmleaf.{f.name}", None) or os.environ.get(f"PALMLEAF_{f.name.upper()}")
            got[f.name] = type(f.default)(raw) if raw else f.default
        if missing := [n for n in required if not got[n]]:
            raise ValueError(f"settings without a value: {', '.join(missing)}")
        return cls(**got)
