"""Removal of long substrings that occur earlier, exact to the byte.

Texts are cut into stretches: the windows of ``length`` bytes that have the same leftmost
smallest gram. Equal windows have equal grams, so only stretches whose gram occurs twice can
repeat anything. Equal stretches are grouped first. Where a gram has several different
stretches, they meet in a bounded block: its suffixes are sorted, and from the
Burrows-Wheeler transform intervals are expanded backward, breadth first, which gives the
common prefixes of neighbouring suffixes by increasing value. Expansion stops at ``length``:
suffixes not yet told apart share a window. Grams with very many different stretches are split
into single windows, which are compared whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topictide.llm.store import saved
from topictide.llm.texts import in_slices

LENGTH, GRAM = 100, 32
#: Bytes of stretches in one block, and different stretches of one gram that stay together.
BLOCK_BYTES, GRAM_STRETCHES = 1 << 20, 4096
#: A place packs 24 bits of the text's hash, its start (a text has less than 2 GB) and its number of windows.
SALT_BITS, START_BITS, COUNT_BITS = 24, 31, 8
#: Rows without an id get one from the hash of their text, in the lowest quarter of the numbers.
NO_ID, NO_ID_BITS = -(1 << 63), 62

_rng = np.random.default_rng(20)
BYTE_CODES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def stretches(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, first window and number of windows of each stretch."""
    n_windows = len(data) - length + 1
    if n_windows < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, size = BYTE_CODES[np.frombuffer(data, np.uint8)], 1
    while size < gram:  # hashes of twice the length, as gram is a power of two
        grams = _scramble(grams[:-size] * np.uint64(0x9E3779B97F4A7C15) + grams[size:])
        size *= 2
    span, least, size = length - gram + 1, grams, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: n_windows], least[span - size : span - size + n_windows])
    # a new stretch begins with another smallest gram, or where the leftmost one has gone
    new = (least[1:] != least[:-1]) | (grams[: n_windows - 1] == least[:-1])
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    return least[starts], starts, np.diff(np.append(starts, n_windows))


def suffix_order(codes: np.ndarray, least: int) -> np.ndarray:
    """Suffixes sorted by ``least`` or more of their first codes, by doubling."""
    n = len(codes)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = codes
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven codes of nine bits
        key = key << np.uint64(9) | padded[k : k + n]
    size = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]]))
        if size >= least or rank[order[-1]] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - size)] = rank[size:]
        key = rank * (n + 1) + after
        size *= 2


def long_prefixes(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares ``length`` codes or more with the one before it in order.

    ``codes`` are 1 to 256, with 0 after each string. The pairs of suffixes with shorter
    common prefixes are found by value: an interval of the order holds the suffixes that begin
    with one string; extended by a code to the left it is an interval again, whose end lies
    between suffixes that share just as much as the string is long, unless that was found
    before. What is not found after ``length - 1`` rounds shares more.
    """
    n = len(codes)
    before = codes[order - 1]  # the transform; the first suffix takes the last code, a 0
    back = np.empty(n, np.int64)
    back[np.argsort(before, kind="stable")] = np.arange(n)
    cut = np.zeros(n + 1, bool)
    cut[[0, n]] = True
    firsts = np.searchsorted(codes[order], np.arange(1, 258))
    low, high = firsts[:-1], firsts[1:]
    cut[high] = True
    cut[firsts[0]] = True
    low, high = low[high > low], high[high > low]
    for _ in range(length - 1):
        if not len(low):
            break
        sizes = high - low
        one = sizes == 1
        alone = low[one]
        alone = alone[before[alone] != 0]
        starts, ends = back[alone], back[alone] + 1
        if not one.all():
            low, sizes = low[~one], sizes[~one]
            owner = np.repeat(np.arange(len(low)), sizes)
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(owner))
            group = owner * 257 + before[rows]
            by = np.argsort(group, kind="stable")
            group, place = group[by], back[rows[by]]
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            last = np.append(edge[1:], len(group)) - 1
            real = group[edge] % 257 != 0
            starts, ends = np.concatenate([starts, place[edge][real]]), np.concatenate([ends, place[last][real] + 1])
        fresh = ~cut[ends]
        low, high = starts[fresh], ends[fresh]
        cut[high] = True
    return ~cut[:n]


def repeated_windows(strings: list[bytes], doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of every window that occurs earlier, by (doc, start), in the strings."""
    sizes = np.array([len(s) for s in strings])
    joined = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    codes = joined.astype(np.uint16) + 1
    codes[firsts + sizes] = 0
    order = suffix_order(codes.astype(np.uint64), length)
    together = long_prefixes(codes.astype(np.int64), order, length)
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    offset = np.arange(len(codes)) - firsts[owner]
    sound = (offset + length <= sizes[owner])[order]
    group = np.cumsum(~together)[sound]
    place = order[sound]
    docs = np.unique(doc, return_inverse=True)[1] if doc.ndim == 1 else np.unique(doc, axis=0, return_inverse=True)[1]
    when = (docs[owner[place]].astype(np.int64) << START_BITS) + start[owner[place]] + offset[place]
    by = np.lexsort((when, group))
    again = np.concatenate([[False], group[by][1:] == group[by][:-1]]) if len(by) else np.zeros(0, bool)
    if len(by):  # the same place can be in one block once only, so only the first of a group stays
        again &= when[by] != when[by][np.maximum.accumulate(np.where(~again, np.arange(len(by)), 0))]
    found = place[by[again]]
    found.sort()
    return owner[found], offset[found]


def _found_stretches(docs: DataFrame, length: int) -> DataFrame:
    """key, sid (of the stretch's bytes), _id and place of every stretch of every text."""
    names = ["key", "sid", "_id", "place"]

    def find(batches):
        for batch in in_slices(batches):
            parts = []
            for ident, salt, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                keys, starts, counts = stretches(data, length)
                sids = [xxhash.xxh3_64_intdigest(data[s : s + c + length - 1]) for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]
                parts.append((keys, np.array(sids, np.uint64), np.full(len(keys), ident), (salt << START_BITS | starts) << COUNT_BITS | counts))
            if parts:
                columns = [np.concatenate(c).astype(np.uint64 if i < 2 else np.int64).view(np.int64) for i, c in enumerate(zip(*parts, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return docs.select("_id", "_salt", "_text").mapInArrow(find, "key long, sid long, _id long, place long")


def _start(place: Column) -> Column:
    return F.shiftright(place, COUNT_BITS).bitwiseAND(F.lit((1 << START_BITS) - 1))


def _texts_at(places: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """``places`` (key, _id, place, many) with the bytes of each stretch as ``data``; by document."""
    listed = places.groupBy("_id").agg(F.collect_list(F.struct("key", "place", "many")).alias("_list"))
    names = ["key", "_id", "place", "many", "data"]

    def cut(batches):
        for batch in in_slices(batches):
            rows = []
            for ident, salt, text, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for item in items:
                    place = item["place"]
                    if place >> START_BITS + COUNT_BITS == salt:
                        start, count = place >> COUNT_BITS & (1 << START_BITS) - 1, place & (1 << COUNT_BITS) - 1
                        rows.append((item["key"], ident, place, item["many"], data[start : start + count + length - 1]))
            if rows:
                kinds = pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    joined = docs.join(listed, "_id").select("_id", "_salt", "_text", "_list")
    return joined.mapInArrow(cut, "key long, _id long, place long, many boolean, data binary")


def _block_spans(rows: DataFrame, length: int) -> DataFrame:
    """_id, salt, first and end of removed runs, from blocks of stretches."""

    def search(table: pa.Table) -> pa.Table:
        ids, places = table["_id"].to_numpy(), table["place"].to_numpy()
        salts, starts = places >> START_BITS + COUNT_BITS, places >> COUNT_BITS & (1 << START_BITS) - 1
        strings, offsets = repeated_windows(table["data"].to_pylist(), np.stack([ids, salts], axis=1), starts, length)
        new = np.concatenate([[True], (strings[1:] != strings[:-1]) | (offsets[1:] != offsets[:-1] + 1)]) if len(strings) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(strings)) - 1 if len(first) else first
        s = strings[first]
        columns = ids[s], salts[s], starts[s] + offsets[first], starts[s] + offsets[last] + length
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["_id", "_salt", "first", "end"])

    return rows.select("block", "_id", "place", "data").groupBy("block").applyInArrow(search, "_id long, _salt long, first long, end long")


def _window_spans(rows: DataFrame, length: int) -> DataFrame:
    """The same from single windows: all but the earliest of equal ones."""
    names = ["window", "_id", "place"]

    def split(batches):
        for batch in batches:
            parts = []
            for ident, place, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parts += [(data[k : k + length], ident, place + (k << COUNT_BITS)) for k in range(len(data) - length + 1)]
            kinds = pa.binary(), pa.int64(), pa.int64()
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)], names=names)

    windows = rows.select("_id", "place", "data").mapInArrow(split, "window binary, _id long, place long")
    windows = saved(windows.select(F.xxhash64("window").alias("h1"), F.xxhash64(F.lit(1), "window").alias("h2"), "_id", "place"))
    firsts = windows.groupBy("h1", "h2").agg(F.min(F.struct("_id", "place")).alias("_first"))
    later = windows.join(firsts, ["h1", "h2"]).where((F.col("_id") != F.col("_first._id")) | (F.col("place") != F.col("_first.place")))
    return later.select("_id", F.shiftright("place", START_BITS + COUNT_BITS).alias("_salt"), _start(F.col("place")).alias("first"), (_start(F.col("place")) + length).alias("end"))


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """_id, _salt, first and end of spans to remove; spans of a document may overlap.

    ``docs`` has _id, _salt and _text.
    """
    found = _found_stretches(docs, length)
    often = found.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("key")
    met = saved(found.join(often, "key"))
    alike = met.groupBy("key", "sid").agg(F.min(F.struct("_id", "place")).alias("_first"))
    alike = saved(alike.select("key", "sid", F.col("_first._id").alias("_id"), F.col("_first.place").alias("place")))
    firsts = alike.select("key", "sid", F.col("_id").alias("_id1"), F.col("place").alias("_place1"))
    copies = met.join(firsts, ["key", "sid"]).where((F.col("_id") != F.col("_id1")) | (F.col("place") != F.col("_place1")))
    count = F.col("place").bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    spans = copies.select(
        "_id", F.shiftright("place", START_BITS + COUNT_BITS).alias("_salt"), _start(F.col("place")).alias("first"),
        (_start(F.col("place")) + count + length - 1).alias("end"),
    )
    several = alike.groupBy("key").agg(F.count(F.lit(1)).alias("_kinds")).where(F.col("_kinds") > 1)
    wanted = alike.join(several, "key").select("key", "_id", "place", (F.col("_kinds") > GRAM_STRETCHES).alias("many"))
    texts = saved(_texts_at(wanted, docs, length))
    few, many = texts.where(~F.col("many")), texts.where("many")
    n_blocks = max(1, math.ceil((few.agg(F.sum(F.octet_length("data"))).first()[0] or 0) / BLOCK_BYTES))
    spans = spans.unionByName(_block_spans(few.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))), length))
    if many.limit(1).count():
        spans = spans.unionByName(_window_spans(many, length))
    return spans


def _left(text: str, spans: list[dict] | None) -> tuple:
    data = text.encode("utf-8", "surrogatepass")
    kept, at, n_spans = [], 0, 0
    runs: list[list[int]] = []
    for first, end in sorted((s["first"], s["end"]) for s in spans or ()):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([first, end])
    for first, end in runs:
        kept.append(data[at:first])
        at, n_spans = end, n_spans + 1
    left = b"".join([*kept, data[at:]])
    return len(data), len(data) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left


def drop_repeated_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes of every row.

    Removed is each byte covered by a ``length``-byte string of the input that also starts
    earlier: in a document with a smaller id, or earlier in the same one. A null text counts
    as empty. Rows with the same id and text count as one document and each get its result;
    different texts of one id are ordered by their hash. A null id is smaller than ids from
    -2**62 on, and rows without one are ordered by the hash of their text. An empty table
    gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unnamed = F.xxhash64(text).bitwiseAND(F.lit((1 << NO_ID_BITS) - 1)) + F.lit(NO_ID)
    ident = F.coalesce(F.col("doc_id").cast("long"), unnamed)
    salt = F.pmod(F.xxhash64(F.lit(SALT_BITS), text), F.lit(1 << SALT_BITS))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ident.alias("_id"), salt.alias("_salt"), text.alias("_text"))
    spans = removed_spans(keyed, length)
    listed = spans.groupBy("_id", "_salt").agg(F.collect_list(F.struct("first", "end")).alias("_spans"))
    joined = keyed.join(listed, ["_id", "_salt"], "left")
    return joined.withColumn("_out", _left_column()(F.col("_text"), F.col("_spans"))).select("doc_id", "_out.*")


def _left_column():
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept_bytes": pa.binary()}

    def batch(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = [_left(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    batch.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
