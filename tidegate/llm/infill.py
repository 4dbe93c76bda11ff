"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix, and the middle is moved to the end.

A text is a sequence of units, code points unless another pattern is given. Their end offsets are found from left to right
by the regex library and kept in a compact array; two look-ups in it slice the text. Where to cut, and which form
a document takes, follow from a digest of its id, so reruns and lost executors change nothing.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that stand before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = "(?s:.)"
#: Units of one match: the ends of all of them are read at once.
AT_ONCE = 256


@lru_cache(maxsize=8)
def _units(unit: str) -> regex.Pattern:
    return regex.compile(f"(?:({unit})){{1,{AT_ONCE}}}+")


def unit_ends(text: str, unit: str = CODE_POINT) -> array:
    """The end offset of each unit; what lies between two matches belongs to the unit after it, what is left to the last."""
    ends = array("I")
    for m in _units(unit).finditer(text):
        ends.fromlist(m.ends(1))
    if text and (not ends or ends[-1] < len(text)):
        if ends:
            ends[-1] = len(text)
        else:
            ends.append(len(text))
    return ends


def draws(seed: int, doc_id: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that a document's id gives."""
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def transformed(text: str, doc_id: str, unit: str = CODE_POINT, seed: int = 1, rate: int = 90, spm: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """Units, form (plain, psm or spm), characters of prefix and middle (None if plain), and the text in that form.

    Of 100 texts ``rate`` are transformed, and of 100 of these ``spm`` have the suffix first. A text that is empty or holds a
    mark stays plain.
    """
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not n or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first - 1] if first else 0, ends[last - 1] if last else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text from its form. No mark can begin inside another, so the first of each kind is the one that was put there."""
    if form == "plain":
        return output
    head, inner = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    first, rest = output[len(head) :].split(inner, 1)
    second, middle = rest.split(MIDDLE, 1)
    return first + middle + second if form == "psm" else second + middle + first


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(df: DataFrame, text: str = "text", id: str = "doc_id", unit: str = CODE_POINT, seed: int = 1, rate: int = 90, spm: int = 20, output: bool = True) -> DataFrame:
    """One row per row: the id, n (units), form, prefix_chars, middle_chars, output (left out unless asked for), output_sha256
    and restored_sha256, the digest of the text rebuilt from output and form.

    A null text counts as empty, which is plain and gives empty output; a null id draws like an empty one. Rows are judged alone,
    so repeated rows give equal ones; other columns, whatever their names, are left out. An empty table gives an empty table.
    A text is whole in one row of an Arrow batch and never cut, however long.
    """
    kinds = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"
    names = [k.split()[0] for k in kinds.split(", ")]

    @F.pandas_udf(kinds)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = []
            for doc_id, x in zip(ids, texts, strict=True):
                n, form, a, b, out = transformed(x, doc_id, unit, seed, rate, spm)
                rows.append((n, form, a, b, out if output else None, _digest(out), _digest(restored(out, form))))
            made = pd.DataFrame(rows, columns=names)
            yield made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = df.select(F.col(id).alias("__id"), run(F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("__fim"))
    return made.select(F.col("__id").alias(id), *[F.col(f"__fim.{k}").alias(k) for k in names if output or k != "output"])
