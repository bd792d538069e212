"""Packing text units into chunks for a detector that reads a limited number of characters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import SPACE
from ..functions.limits import Limits


def pieces(text: str, limit: int) -> list[str]:
    """The text itself, or if longer its lines gathered up to the limit, longer lines cut; blank pieces dropped."""
    out, held, size = [], [], 0
    if len(text) <= limit:
        out.append(text)
    else:
        for line in text.split("\n"):
            if held and (len(line) > limit or size + 1 + len(line) > limit):
                out.append("\n".join(held))
                held, size = [], 0
            if len(line) > limit:
                out += [line[i : i + limit] for i in range(0, len(line), limit)]
            elif held or line:  # an empty line begins no piece
                size += len(line) + bool(held)
                held.append(line)
        out += ["\n".join(held)] if held else []
    return [p for p in out if re.search(f"[^{SPACE}]", p)]


def chunks(units: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, chunk_id, text) of units(doc_id, unit_id, text) in order of unit_id: pieces joined by an empty line while they fit.

    The units are sorted by document and place and read in one pass that holds no more than a chunk, so a document may be of any length.
    """
    limit = Limits.of(units.sparkSession).max_chunk if limit is None else limit
    rows = units.select("doc_id", "unit_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        none = object()
        doc, number, held, size = none, 0, [], 0
        for batch in batches:
            out = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != doc or doc is none:
                    out += [(doc, number, "\n\n".join(held))] if held else []
                    doc, number, held, size = own, 0, [], 0
                for piece in pieces(text, limit):
                    if held and size + len(piece) + 2 > limit:
                        out.append((doc, number, "\n\n".join(held)))
                        number, held, size = number + 1, [], 0
                    size += len(piece) + 2 * bool(held)
                    held.append(piece)
            ids = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((ids, pa.int32(), pa.string()))], ["doc_id", "chunk_id", "text"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((doc, number, "\n\n".join(held)), (ids, pa.int32(), pa.string()), strict=True)], ["doc_id", "chunk_id", "text"])

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "unit_id").mapInArrow(run, f"doc_id {kind}, chunk_id int, text string")
