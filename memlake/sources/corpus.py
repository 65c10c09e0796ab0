"""Text corpora: whole-file reading, marker trimming, chunking and chunk files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.functions.text import CHUNK_END_MARKS, CHUNK_STOPS, CLOSING_MARKS, trim_markers

CHUNK_SCHEMA = "doc_id bigint, id int, size int, content string"


def read_corpus(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Whole text files with the part between two markers kept."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return raw.select("path", trim_markers(F.col("value"), start, end).alias("text"))


def _cuts(doc_id: int, text: str, low: int, high: int, stops: str) -> list[int]:
    """Ends of the pieces of one text.

    All places where a sentence stops are known beforehand, as is for each place
    the first one behind it that is no closing mark. The aim of a piece lies
    between two stops; the nearer one ends it, the earlier of equals, unless it
    would leave half a minimal piece or less. Without either, the aim itself ends it.
    """
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = np.flatnonzero(np.isin(chars, [ord(c) for c in stops]))
    open_at = np.append(np.flatnonzero(~np.isin(chars, [ord(c) for c in CLOSING_MARKS])), len(text))
    ends = [0]
    while ends[-1] + high < len(text):
        at = ends[-1]
        aim = at + low + zlib.crc32(f"{doc_id}:{len(ends)}".encode()) % (high - low + 1)
        usable, nearest = np.searchsorted(stop, [at + low // 2 + 1, aim])
        around = stop[max(usable, nearest - 1):nearest + 1]
        end = int(around[np.abs(around - aim).argmin()]) + 1 if len(around) else aim
        ends.append(int(open_at[np.searchsorted(open_at, end)]))
    return ends[1:] + [len(text)] * (ends[-1] < len(text))


def _pieces(doc_id: int, text: str | None, low: int, high: int, stops: str) -> Iterator[tuple[int, str]]:
    ends = _cuts(doc_id, text, low, high, stops) if text else []
    for number, (a, b) in enumerate(zip([0, *ends], ends), 1):
        yield number, text[a:b]


def corpus_chunk(df: DataFrame, low: int = 300, high: int = 2000, stops: str = CHUNK_STOPS) -> DataFrame:
    """Cut every document (`doc_id`, `text`) into pieces that end at sentence stops.

    Where each cut falls depends on the one before, so a document is walked in
    one pass; documents are independent and need no shuffle. The aimed size is
    a hash of document and piece number, so reruns give the same pieces.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, len(c), c) for d, t in zip(batch.doc_id, batch.text)
                    for i, c in _pieces(d, t, low, high, stops)]
            yield pd.DataFrame(rows, columns=["doc_id", "id", "size", "content"])

    return df.select("doc_id", "text").mapInPandas(run, CHUNK_SCHEMA)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    return spark.read.schema("id int, size int, content string").json(path, multiLine=one_array)


def resume_chunks(chunks: DataFrame, cursor: int, n: int) -> DataFrame:
    """The next n chunks after a cursor, in id order."""
    return chunks.filter(F.col("id") > cursor).orderBy("id").limit(n)


def chunk_quality(chunks: DataFrame) -> DataFrame:
    """Share of chunks that end well, have a sane size and a true size field."""
    ends = F.substring("content", -1, 1).isin(*CHUNK_END_MARKS)
    return chunks.agg(
        F.count("*").alias("chunks"), F.count_if(ends).alias("good_end"),
        F.count_if(F.col("size").between(100, 4000)).alias("good_size"),
        F.count_if(F.col("size") == F.length("content")).alias("true_size"))
