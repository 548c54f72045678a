"""Token counts by offset-mapped attribution."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder, default_path

_KEPT = ("field", "section", "start", "end", "n_tokens", "n_shared")


def token_spans(text: str, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens that tile the bytes of a text; a token owns every character it touches."""
    if text.isascii():
        ends = np.cumsum(byte_lengths)
        return ends - byte_lengths, ends
    codes = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((codes & 0xC0) != 0x80) - 1
    ends = np.cumsum(byte_lengths)
    return character[ends - byte_lengths], character[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of every token, and whether the token reaches into more than one.

    ``bounds`` are the starts of sections that tile the text, and its end. A token goes to the
    section that holds most of its characters, the earlier of equals.
    """
    first = np.searchsorted(bounds[:-1], starts, side="right") - 1
    last = np.searchsorted(bounds[:-1], ends - 1, side="right") - 1
    shared = first != last
    section = first.copy()
    for t in np.flatnonzero(shared):
        inside = np.arange(first[t], last[t] + 1)
        held = np.minimum(bounds[inside + 1], ends[t]) - np.maximum(bounds[inside], starts[t])
        section[t] = inside[int(np.argmax(held))]
    return section, shared


def _sections(fields: Sequence[str], by_line: bool, separator: str) -> tuple[str, list[tuple[int, int]], np.ndarray]:
    """The document, the (field, number) of each section, and the sections' bounds."""
    names, bounds, at = [], [], 0
    for f, value in enumerate(fields):
        body = value + (separator if f < len(fields) - 1 else "")
        lines = body.split("\n")
        cuts = [0]
        if by_line and len(lines) > 1:
            cuts = [0, *np.cumsum([len(x) + 1 for x in lines[:-1]]).tolist()]
            if cuts[-1] == len(body):
                cuts.pop()
        names += [(f, k) for k in range(len(cuts))]
        bounds += [at + c for c in cuts]
        at += len(body)
    return separator.join(fields), names, np.array([*bounds, at], np.int64)


def _count_batches(path: str, n_fields: int, by_line: bool, separator: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path)
            columns = [batch.column(k + 1).to_pylist() for k in range(n_fields)]
            row: list[int] = []
            out: list[list] = [[] for _ in _KEPT]
            for i, values in enumerate(zip(*columns, strict=True)):
                text, names, bounds = _sections(values, by_line, separator)
                spans = token_spans(text, encoder.byte_lengths(encoder.encode(text)))
                section, shared = attribute(*spans, bounds)
                n = len(names)
                row += [i] * n
                out[0] += [f for f, _ in names]
                out[1] += [k for _, k in names]
                out[2] += bounds[:-1].tolist()
                out[3] += bounds[1:].tolist()
                out[4] += np.bincount(section, minlength=n).tolist()
                out[5] += np.bincount(section[shared], minlength=n).tolist()
                if len(row) >= 50_000:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, out)], ["id", *_KEPT])
                    row, out = [], [[] for _ in _KEPT]
            if row:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, out)], ["id", *_KEPT])

    return run


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    fields: Sequence[str] = ("text",),
    by: str = "line",
    separator: str = "\n",
    tokenizer: str | None = None,
) -> DataFrame:
    """Tokens per section of every document, each document encoded once and whole.

    A document is its fields joined by ``separator``. Its sections are its fields, or with ``by="line"`` the
    lines of its fields; line breaks and separators belong to the section before them, so sections tile the
    document. Tokens are joined to sections by their character spans; one that crosses a boundary
    goes to the section with most of its characters, the earlier of equals. The counts of a
    document's sections therefore add up to the tokens of the document.

    Returns id, ``field`` (its name), ``section`` (number within the field, from 0), ``start`` and ``end``
    (characters in the document), ``n_tokens``, and ``n_shared`` of them that reach into another section.
    A null or empty field is a section that holds its separator alone, or nothing if it is the last; rows with null or repeated ids are
    counted each for itself; other columns are not looked at. A scan without a shuffle.
    """
    if by not in ("line", "field"):
        raise ValueError("by: line or field")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        *[F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f"f{k}") for k, f in enumerate(fields)],
    )
    counted = rows.mapInArrow(
        _count_batches(tokenizer or default_path(), len(fields), by == "line", separator),
        f"id {kind}, field bigint, section bigint, start bigint, end bigint, n_tokens bigint, n_shared bigint",
    )
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field").cast("int") + 1)
    return counted.select(
        F.col("id").alias(id_col), name.alias("field"), *[F.col(c) for c in _KEPT[1:]]
    )
