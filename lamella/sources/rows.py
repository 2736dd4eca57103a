"""From files to rows: a parser over bytes, applied to files that are rows with their content, or to files read by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lamella.sources.ranges import Held, Ranges, opened


#: Rows of small files that go back to Spark together: a frame for each file would cost more than parsing it.
BATCH = 2000


def parsed(files: DataFrame, parser: Callable[[Ranges], Iterator[tuple]], schema: str) -> DataFrame:
    """files: path, and content or not. A row for each tuple that the parser gives, after the path; schema names its columns and
    ends with an error, which a malformed file gives in a row of its own after what was found before."""
    names = ["path", *(f.split()[0] for f in schema.split(", "))]
    held = "content" in files.columns
    width = len(names) - 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for frame in frames:
            for row in frame.itertuples(index=False):
                source = Held(bytes(row.content or b"")) if held else opened(row.path)
                try:
                    for x in parser(source):
                        out.append((row.path, *x, None))
                except (ValueError, IndexError, KeyError, EOFError) as error:
                    out.append((row.path, *[None] * width, str(error) or type(error).__name__))
                finally:
                    if not held:
                        source.close()
                if len(out) >= BATCH:
                    yield pd.DataFrame(out, columns=names, dtype=object)
                    out = []
        yield pd.DataFrame(out, columns=names, dtype=object)

    return files.select(*(["path", "content"] if held else ["path"])).mapInPandas(run, f"path string, {schema}")


def exactly(source: Ranges, at: int, n: int) -> bytes:
    raw = source.read(at, n)
    if len(raw) < n:
        raise ValueError(f"cut off at {at}")
    return raw


def heads(files: DataFrame, n: int) -> DataFrame:
    """files: path. path, content: the first bytes of each, read by position."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path in frame["path"]:
                source = opened(path)
                try:
                    out.append((path, source.read(0, n)))
                finally:
                    source.close()
            yield pd.DataFrame(out, columns=["path", "content"])

    return files.select("path").mapInPandas(run, "path string, content binary")
