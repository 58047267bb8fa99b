"""Best-fit packing: sequences planned on the histogram of lengths, pieces joined to planned slots.

1. Every document is tokenized and cut; the pieces are written once with their rank among the pieces
   of equal length in the same partition.
2. The histogram (at most ``max_len`` rows) is packed best-fit decreasing over counts: groups of equal
   sequences are filled together, so the plan's size depends on ``max_len``, not on the corpus.
3. A piece's rank within its length is its rank in the partition plus the counts of earlier partitions;
   the plan's run that holds this rank (binary search) gives sequence and offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, text_or_empty, written
from .tokens import shared_encoder

MAX_LEN, END_ID = 2048, 0


def cut_lengths(n: int, max_len: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids: full pieces, the first one takes the rest."""
    if n <= max_len:
        return [n]
    rest = n % max_len
    return ([rest] if rest else []) + [max_len] * (n // max_len)


def _tokenizer(path: str, max_len: int, keep_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared_encoder(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        seen: dict[int, int] = {}
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            size = 0
            for doc, part, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
                raw, at = enc.encode_bytes(text.as_py()) + end, 0
                for k, n in enumerate(cut_lengths(len(raw) // 4, max_len)):
                    ids = raw[4 * at:4 * (at + n)]
                    rank = seen.get(n, 0)
                    seen[n] = rank + 1
                    for c, v in zip(cols, (doc, k, at, n, zlib.crc32(ids), rank, ids if keep_ids else None), strict=True):
                        c.append(v)
                    at += n
                size += len(raw)
                if keep_ids and size > 8_000_000:
                    yield _piece_batch(cols, part, keep_ids)
                    cols, size = [[], [], [], [], [], [], []], 0
            if cols[0]:
                yield _piece_batch(cols, part, keep_ids)

    return pieces


def _piece_batch(cols, part, keep_ids) -> pa.RecordBatch:
    arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:6]),
              pa.array([part] * len(cols[0]), pa.int64())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"]
    if keep_ids:
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in cols[6]])]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(cols[6]), dtype="<u4").astype(np.int32))
        arrays, names = [*arrays, pa.ListArray.from_arrays(pa.array(offsets), flat)], [*names, "ids"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, keep_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, rank, part`` and, unless told otherwise, ``ids`` per piece, written once in
    the shared folder. ``rank`` counts the pieces of equal length within the task ``part``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().cast("long").alias("part"),
                       text_or_empty().alias("text"))
    out = rows.mapInArrow(_tokenizer(tokenizer_path, max_len, keep_ids),
                          "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part long" + ", ids array<int>" * keep_ids)
    return written(out, "pieces", TEXT_ROWS)


def plan_best_fit(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Runs ``(length, first_rank, pieces, per_sequence, first_sequence, offset)``:
    the piece of this length with rank ``first_rank + j`` goes to sequence ``first_sequence + j // per_sequence``
    at ``offset + (j % per_sequence) * length``.

    Open sequences are kept as groups (first sequence, how many) by free space. A length takes the tightest
    groups first, each sequence as often as it fits, and splits at most one group per use of a free space."""
    free: dict[int, list[tuple[int, int]]] = {}
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                per = max_len // length
                n, room = -(-left // per), max_len
                groups, sequences = [(sequences, n)], sequences + n
            else:
                groups = free.pop(room)
                per = room // length
            while groups and left:
                first, n = groups.pop()
                full = min(n, left // per)
                if full:
                    runs.append((length, rank, full * per, per, first, max_len - room))
                    rank, left = rank + full * per, left - full * per
                    if room > per * length:
                        free.setdefault(room - per * length, []).append((first, full))
                    first, n = first + full, n - full
                if n and left:      # fewer pieces left than one sequence takes
                    runs.append((length, rank, left, left, first, max_len - room))
                    free.setdefault(room - left * length, []).append((first, 1))
                    first, n, left = first + 1, n - 1, 0
                if n:
                    groups.append((first, n))
            if groups:
                free.setdefault(room, []).extend(groups)
    return runs


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, keep_ids: bool = True) -> DataFrame:
    """Pack ``docs`` (``doc_id, text``) into sequences of at most ``max_len`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``. A document is its
    token ids followed by id 0; only longer documents are cut (``cut_lengths``). Sequences are filled from
    offset 0 without gaps. With ``keep_ids`` false there is no ``ids`` column: the plan alone, as ``ids_crc32`` (of all
    ids) and ``length`` describe it.

    Null or empty text is the end id alone. Null doc_ids and repeated rows are documents of their own. Very
    long texts are encoded in parts that join exactly. An empty table gives an empty result; extra columns
    are ignored.
    """
    pieces = tokenize_pieces(docs, tokenizer_path, max_len, keep_ids)
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("_n"))
    # one row per length: at most max_len
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = plan_best_fit(counts, max_len)
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # written, so that its size is known: while it is small Spark broadcasts it and the ids are not shuffled
    starts = written(by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("_before")), "piece-starts")
    ranked = pieces.join(starts, ["length", "part"]).withColumn("_rank", F.col("rank") + F.col("_before"))
    return (ranked.withColumn("_slot", _slot_finder(runs)("length", "_rank"))
            .select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "_slot.sequence_id", "_slot.offset"))


def _slot_finder(runs):
    """(length, rank) -> slot by binary search in the plan's sorted runs."""
    table = np.array(sorted(runs) or [(0, 0, 0, 1, 0, 0)], dtype=np.int64)
    keys = table[:, 0] << 50 | table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        run = table[np.searchsorted(keys, n << 50 | r, side="right") - 1]
        j = r - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 4] + j // run[:, 3], "offset": run[:, 5] + j % run[:, 3] * n})

    return find


def assemble(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the pieces of each sequence in place (a group holds at most max_len tokens)."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("_p")).select("sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"))
