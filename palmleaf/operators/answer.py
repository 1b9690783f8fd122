"""Retrieval-augmented answers: context, prompt, injected model, classification, citations, page."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.functions import patterns as P
from palmleaf.functions.text import is_blank, row_by_row, strip
from palmleaf.operators.ledger import Ledger
from palmleaf.shared import fresh

# The prompt, the page and the labels of citations.
PROMPT_HEAD = "Dựa vào các đoạn văn sau, hãy trả lời câu hỏi: '"
PROMPT_RULES = (
    "'. Nếu câu trả lời không thể tìm thấy trực tiếp hoặc suy luận rõ ràng từ các đoạn văn được cung cấp, "
    f"hãy nói chính xác: '{P.NO_INFO}' "
    "Không suy diễn thông tin từ kiến thức chung của bạn. \n\nCác đoạn văn được cung cấp:\n"
)
CITATION_LABELS = [("Bộ", "Bộ"), ("Tên Kinh Đầy Đủ", "Kinh"), ("Việt Dịch", "Dịch"), ("Số Phẩm", "Phần"), ("Tên Kinh Nhỏ", "Kinh")]
ANSWER_HEAD = "🧠 **Câu trả lời từ AI:**\n"
SOURCES_HEAD = "📚 **Ngữ cảnh liên quan từ:**\n"
NO_SOURCES = "📚 **Không tìm thấy ngữ cảnh liên quan trong cơ sở dữ liệu.**"
SOURCES_HIDDEN = "📚 **Không có ngữ cảnh liên quan được hiển thị do thông tin không đủ hoặc lỗi.**"


def contexts(hits: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, context, documents): the documents of (keys, rank, document) in rank order, joined by line feeds."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))), lambda x: F.coalesce(x["document"], F.lit("")))
    return hits.groupBy(*keys).agg(ordered.alias("documents")).withColumn("context", strip(F.array_join("documents", "\n")))


def prompt(question: Column, context: Column) -> Column:
    """The instruction with question and passages; the bare question where the context is blank."""
    full = F.concat(F.lit(PROMPT_HEAD), question, F.lit(PROMPT_RULES), F.lit("'''\n"), context, F.lit("\n'''"))
    return F.when(is_blank(context), question).otherwise(full)


def limited(fn: Callable[[str], str], seconds: float) -> Callable[[str], str]:
    """`fn` with a time limit for each call; what takes longer raises TimeoutError, and its thread is left to end by itself."""

    def call(x: str) -> str:
        got: queue.SimpleQueue = queue.SimpleQueue()

        def run() -> None:
            try:
                got.put((fn(x), None))
            except Exception as e:  # raised again by the caller
                got.put((None, e))

        threading.Thread(target=run, daemon=True).start()
        try:
            answer, error = got.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(f"no answer within {seconds:g} s") from None
        if error is not None:
            raise error
        return answer

    return call


def answered(rows: DataFrame, answer_fn: Callable[[str], str], prompt_col: str = "prompt", out: str = "answer") -> DataFrame:
    """Answers from an injected model, called on the executors; its exceptions become error answers.

    Retries are the function's own affair; `limited` gives it a time limit and `throttled` a rate.
    """

    def one(text: str) -> str:
        try:
            return answer_fn(text)
        except Exception as e:  # reported as an answer, as users see it
            return f"{P.ERROR_PREFIX}{e}"

    ask = row_by_row(one, "string", pa.string(), nulls=True)
    return rows.withColumn(out, settled(ask(F.col(prompt_col))))


def answered_once(rows: DataFrame, ledger: Ledger, answer_fn: Callable[[str], str], prompt_col: str = "prompt", out: str = "answer", per_minute: float | None = None, workers: int = 4) -> DataFrame:
    """As `answered`, but through a ledger: equal prompts are one call, and what was answered before, by a task or job that failed too,
    isn't asked again. Error answers aren't kept, so they are tried again next time."""
    key, told = fresh(rows, "key"), fresh(rows, "told")
    keyed = rows.withColumn(key, ledger.key(F.col(prompt_col), "answer"))
    got = ledger.ask(keyed.select(F.col(key).alias("key"), F.col(prompt_col).alias("prompt")), answer_fn, per_minute, workers)
    said = F.coalesce("answer", F.concat(F.lit(P.ERROR_PREFIX), F.col("error")))
    both = keyed.drop(out).join(got.select(F.col("key").alias(key), said.alias(told)), key, "left")
    return both.withColumn(out, settled(F.col(told))).drop(key, told)


def settled(answer: Column) -> Column:
    """The answer, or the no-information text where it is blank or says anywhere that nothing was found."""
    return F.when(P.is_no_info(answer), F.lit(P.NO_INFO)).otherwise(answer)


def answer_kind(answer: Column) -> Column:
    return F.when(P.is_no_info(answer), "no_info").when(P.is_error(answer), "error").otherwise("answer")


def citation(meta: Column) -> Column:
    """The labelled metadata values that are there, comma-joined."""
    value = lambda k: F.try_element_at(meta, F.lit(k))
    return F.concat_ws(", ", *[F.when(value(k) != "", F.concat(F.lit(f"{label}: "), value(k))) for k, label in CITATION_LABELS])


def citations(hits: DataFrame, keys: tuple[str, ...] = ("query_id",), meta_col: str = "metadata") -> DataFrame:
    """(keys, citations): the distinct non-empty citations of each query in code point order."""
    named = hits.select(*keys, citation(F.col(meta_col)).alias("citations"))
    return named.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("citations") != "", F.col("citations")))).alias("citations"))


def page(question: Column, answer: Column, cites: Column) -> Column:
    """What the user sees: a request to ask for a blank question, else the answer and its citations, none for errors and no information."""
    sources = F.when(F.size(cites) > 0, F.concat(F.lit(SOURCES_HEAD), F.array_join(F.transform(cites, lambda c: F.concat(F.lit("_ "), c, F.lit("_"))), "\n"))).otherwise(NO_SOURCES)
    hidden = (answer == P.NO_INFO) | P.is_error(answer)
    body = F.concat(F.lit(ANSWER_HEAD), answer, F.lit("\n\n"), F.when(hidden, SOURCES_HIDDEN).otherwise(sources))
    return F.when(is_blank(question), P.ASK_AGAIN).otherwise(body)
