"""Token counts, with overlap resynchronisation for huge documents.

A text of at most ``chunk_chars`` characters is encoded as it is. A longer one is cut into chunks that
overlap, each encoded with offsets, and the parts are spliced at a boundary that both encodings share
and that is proven stable: a character that follows white space, where the left encoding has ended a
token and both encodings start one. The normaliser and the pre-tokeniser of a word tokenizer never
join across white space, so what lies left of such a boundary cannot change what lies right of it.
Where the overlap holds no such boundary it is doubled, up to the rest of the text, which needs none.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS, OVERLAP_CHARS, LIMIT = 1 << 16, 1 << 9, 2048
#: Characters given to the library in one call.
CALL_CHARS = 1 << 18


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _stable(text: str, left: list[tuple[int, int]], right: set[int], lo: int, hi: int) -> int | None:
    """The largest stable boundary in [lo, hi): offsets in the text at which both encodings start a token."""
    for s, _ in reversed(left):
        if s < lo:
            return None
        if s < hi and s in right and text[s - 1].isspace():
            return s
    return None


def spliced_ids(t, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[int]]:
    """The ids of a text in parts, equal together to those of the whole text."""
    n, begin = len(text), 0
    while begin < n:
        end, wide = begin + chunk, overlap
        while True:
            if end >= n:
                yield t.encode(text[begin:], add_special_tokens=False).ids
                return
            # the right chunk starts wide characters before the end of the left one
            cut = max(begin + 1, end - wide)
            left = t.encode(text[begin:end], add_special_tokens=False)
            spans = [(begin + a, begin + b) for a, b in left.offsets]
            right = {cut + a for a, _ in t.encode(text[cut : end + wide], add_special_tokens=False).offsets}
            # a token that touches either chunk's edge may be cut there: stay inside
            at = _stable(text, spans, right, cut + 1, end)
            if at is not None and at > begin:
                k = next(i for i, (a, _) in enumerate(spans) if a >= at)
                yield left.ids[:k]
                begin = at
                break
            wide *= 2
            end = end + wide  # alignment failed: a wider overlap, and a longer left chunk to hold it


def count(t, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    return sum(map(len, spliced_ids(t, text, chunk, overlap)))


def token_counts(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row: ``keep``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` names the tokenizer's file, which every executor has. A null text counts as empty: 0 bytes,
    0 tokens. No row is dropped and none is merged, so repeated rows and null ids give a row each;
    other columns, whatever their names, are left out. An empty table gives an empty table.
    """
    source = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = source.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__text")).fill_null("")
            counts, waiting, held = [0] * len(column), [], 0

            def flush():
                encoded = t.encode_batch_fast([x for _, x in waiting], add_special_tokens=False)
                for (i, _), e in zip(waiting, encoded, strict=True):
                    counts[i] = len(e)
                waiting.clear()

            for i, x in enumerate(column):
                x = x.as_py()
                if len(x) > chunk:
                    counts[i] = count(t, x, chunk, overlap)
                elif x:
                    waiting.append((i, x))
                    held += len(x)
                    if held > CALL_CHARS:
                        flush()
                        held = 0
            if waiting:
                flush()
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.compute.binary_length(column.cast(pa.large_string()).cast(pa.large_binary())).cast(pa.int64()), n, pa.compute.greater(n, limit)],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    return source.mapInArrow(run, schema)
