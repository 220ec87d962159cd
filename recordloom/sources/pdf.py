"""PDF helpers over a pluggable engine: page counts, text samples, chunks, and repair with a second try."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.lifecycle import chunk_plan

#: Pages of a text sample.
SAMPLE_PAGES = 3


class Engine(Protocol):
    """What a PDF library must give; an error of any of these is a row and no end of the job."""

    def page_count(self, content: bytes) -> int: ...

    def text(self, content: bytes, first: int, last: int) -> str: ...

    def repair(self, content: bytes) -> bytes: ...


def inspect(files: DataFrame, engine: Engine) -> DataFrame:
    """sha256, page_count, sample (text of the first pages), repaired, error of PDF files (sha256, content). A file that cannot be read is
    repaired (decrypted, rendered again) and read once more."""

    def look(content: bytes) -> tuple[int, str]:
        n = engine.page_count(content)
        return n, engine.text(content, 1, min(n, SAMPLE_PAGES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sha, content in zip(b["sha256"], b["content"], strict=True):
                try:
                    rows.append((sha, *look(content), False, None))
                except Exception:
                    try:
                        rows.append((sha, *look(engine.repair(content)), True, None))
                    except Exception as e:
                        rows.append((sha, None, None, True, str(e)[:500]))
            out = pd.DataFrame(rows, columns=["sha256", "page_count", "sample", "repaired", "error"])
            yield out.astype({"page_count": "Int64"})

    return files.select("sha256", "content").mapInPandas(run, "sha256 string, page_count int, sample string, repaired boolean, error string")


def chunks(files: DataFrame, inspected: DataFrame, engine: Engine, size: int = 40) -> DataFrame:
    """sha256, start, pages, ocr_used, error of the chunks of PDF files, for ``lifecycle.merge_chunks``; each chunk is a row of its own
    before any of it is read, so that one long file is shared by many tasks."""
    planned = inspected.where("error IS NULL").select("sha256", F.explode(chunk_plan(F.col("page_count"), size)).alias("c")).select("sha256", "c.start", "c.stop")
    held = files.select("sha256", "content").join(planned, "sha256")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sha, content, start, stop in zip(b["sha256"], b["content"], b["start"], b["stop"], strict=True):
                try:
                    pages = [{"page": p, "markdown": engine.text(content, start + p, start + p)} for p in range(1, stop - start + 1)]
                    rows.append((sha, start, pages, False, None))
                except Exception as e:
                    rows.append((sha, start, None, False, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["sha256", "start", "pages", "ocr_used", "error"])

    return held.mapInPandas(run, "sha256 string, start int, pages array<struct<page:int,markdown:string>>, ocr_used boolean, error string")
