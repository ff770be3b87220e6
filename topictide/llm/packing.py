"""Best-fit packing of token pieces under several capacities at once.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths). Every piece, longest first, goes to the open sequence that has room in all
three and scores best: by the smallest weighted norm of what would be left, or by the largest
weighted dot product of need and room. Pieces are dealt evenly into groups of bounded size,
which are packed apart; each leaves about one sequence unfilled.
"""

from __future__ import annotations

import dataclasses
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from topictide.llm.store import saved
from topictide.llm.texts import in_slices
from topictide.llm.tokens import word_encoder


@dataclasses.dataclass(frozen=True)
class Capacity:
    """Room of one sequence. By default only tokens bind; the others can be set lower."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    rule: str = "norm"  # or "dot"

    def limits(self) -> np.ndarray:
        documents = self.documents or self.tokens
        return np.array([self.tokens, documents, self.attention or self.tokens**2], float)


#: Pieces packed together in one task.
GROUP_PIECES = 8192


def token_pieces(
    docs: DataFrame, tokenizer_path: str, tokens: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if wanted, the ids.

    A document's ids end with ``end_id``. Only documents longer than ``tokens`` are cut. A
    null or empty text has the end id alone. Repeated rows each give their own pieces; null
    ids are kept; other columns are not read.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema = StructType.fromDDL(schema + (", ids array<int>" if with_ids else ""))

    def cut(batches):
        encoder, end, size = word_encoder(tokenizer_path), np.uint32(end_id).astype("<u4").tobytes(), 4 * tokens
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for batch in in_slices(batches, 3000):
            rows = []
            encoded = encoder.encode([text or "" for text in batch.column(1).to_pylist()])
            for doc, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    row = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append(row + (np.frombuffer(part, "<i4"),) if with_ids else row)
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(cut, schema)


def fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; lengths come longest first and none is above capacity."""
    limits, weights = capacity.limits(), np.array(capacity.weights, float)[:, None]
    needs = np.stack([lengths, np.ones(len(lengths)), np.square(lengths, dtype=float)])
    shares = needs / limits[:, None]
    room = np.empty((3, 256))
    names = np.empty(256, np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    n_open, least = 0, shares[:, -1:] if len(lengths) else None
    for i in range(len(lengths)):
        need = shares[:, i : i + 1]
        now = room[:, :n_open]
        left = now - need
        fits = (left >= -1e-12).all(axis=0)
        if fits.any():
            score = (weights * left * left).sum(axis=0) if capacity.rule == "norm" else -(weights * need * now).sum(axis=0)
            at = int(np.argmin(np.where(fits, score, np.inf)))
            name = names[at]
        else:
            if n_open == room.shape[1]:
                room = np.concatenate([room, np.empty_like(room)], axis=1)
                names = np.concatenate([names, np.empty_like(names)])
            at, name = n_open, len(used)
            room[:, at], names[at] = 1.0, name
            used.append(0)
            n_open += 1
        bins[i], offsets[i] = name, used[name]
        used[name] += int(lengths[i])
        room[:, at] -= need[:, 0]
        if (room[:, at] < least[:, 0] - 1e-12).any():  # nothing that is still to come fits
            n_open -= 1
            room[:, at], names[at] = room[:, n_open], names[n_open]
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: Capacity = Capacity(), group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset; all other columns ride along.

    ``pieces`` should be a stored table, as it is counted first. Groups are dealt by place in
    the table and not by a key, so no key can make one large. No rows give no rows.
    """
    limits = capacity.limits()
    if capacity.attention and capacity.attention < capacity.tokens**2:
        longest = pieces.agg(F.max("length")).first()[0] or 0
        if longest**2 > limits[2]:
            raise ValueError(f"a piece of {longest} tokens is above the attention capacity")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    schema = StructType(pieces.schema.fields).add("sequence_id", "long").add("offset", "long")

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_group").sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = fit(pdf["length"].to_numpy(np.int64), capacity)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(pack, schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: Capacity = Capacity(), end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with their place; see ``token_pieces`` and ``pack_pieces``."""
    return pack_pieces(saved(token_pieces(docs, tokenizer_path, capacity.tokens, end_id, with_ids)), capacity)
