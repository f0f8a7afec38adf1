"""Best-fit packing (operator 4): bound-certified repacking.

* Every text becomes ids (``tokens``) and an end id; a document longer than a sequence is cut into
  full pieces, of which only the first may be shorter.  Full pieces are sequences by themselves.
* The shorter pieces are dealt by hash into partitions of a bounded number of pieces and packed by
  best-fit decreasing.  A dual-feasible-function bound certifies the partition's number of bins: no
  packing of its pieces can have fewer.
* Partitions with gaps (more bins than their bound) put the documents of their unfilled bins into a
  pool; the pool is dealt anew over partitions of the same bounded number of pieces and packed again.
  A partition that saves no bin that way keeps its old bins and leaves the pool, so rounds end when
  none saves any, or after ``ROUNDS``; no partition grows, however large the pool is.

Edge cases: null and empty texts are the end id alone; repeated doc_ids are documents of their own;
null doc_ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_for, stage, text_batches
from .tokens import encoder, vocabulary

ROOM = 1024
END_ID = 2
PIECES_EACH = 50_000
#: Rounds of dealing the pool anew; rounding functions of the bound, by the parts that a sequence is cut into.
ROUNDS, PARTS = 12, 40


def dff_bound(sizes, room: int = ROOM) -> int:
    """A lower bound on bins for whole sizes in 1..room: the best of the dual feasible functions.

    u(x): the size itself.  For a threshold k up to half the room, sizes over room - k count as a
    whole bin, sizes in between as they are, smaller ones as nothing; and sizes over half the room
    count one bin each with what is left to the middle ones (both are dual feasible).  For p parts, a
    size counts as so many p-ths of a bin as (p + 1)-ths of the room fit into it, or as it is where they
    fill it: of sizes just over a third of the room, no bin holds three.  Thresholds and parts go together."""
    n = np.bincount(np.asarray(sizes, dtype=np.int64), minlength=room + 1)[: room + 1]
    if not n.sum():
        return 0
    at = np.arange(room + 1)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * at)])
    between = lambda c, lo, hi: int(c[hi + 1] - c[lo]) if hi >= lo else 0  # noqa: E731  sizes lo..hi
    best, half = 0, room // 2
    for k in range(0, half + 1):
        large = between(count, room - k + 1, room)
        middle = between(total, max(k, 1), room - k)
        best = max(best, large + -(-middle // room))
        over = between(count, half + 1, room - k)  # in the middle, no two of these share a bin
        spare = over * room - between(total, half + 1, room - k)
        low = between(total, max(k, 1), min(half, room - k))
        best = max(best, large + over + max(0, -(-(low - spare) // room)))
    k = np.arange(half + 1)
    low, high = np.maximum(k, 1), room - k
    large = count[-1] - count[high + 1]
    for p in range(1, PARTS + 1):
        scaled = (p + 1) * at
        worth = np.where(scaled % room == 0, p * at, scaled // room * room)  # of a bin, in parts of p * room
        summed = np.concatenate([[0], np.cumsum(n * worth)])
        best = max(best, int((large - (-(summed[high + 1] - summed[low]) // (p * room))).max()))
    return best


def best_fit_decreasing(sizes: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each size, number of bins.  One list of open bins for each amount of space;
    a bit mask of the amounts in use gives the tightest fit."""
    order = np.argsort(-sizes, kind="stable")
    bins, offs = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(room + 1)]
    mask, made = 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fit = mask >> s
        if fit:
            space = s + (fit & -fit).bit_length() - 1
            b = open_[space].pop()
            if not open_[space]:
                mask &= ~(1 << space)
        else:
            space, b = room, made
            made += 1
        bins[i], offs[i] = b, room - space
        if space > s:
            open_[space - s].append(b)
            mask |= 1 << (space - s)
    return bins, offs, made


def token_pieces(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32); ``row`` tells documents of one doc_id apart."""

    def cut(batches):
        enc, end = encoder(vocab), np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            crcs, lengths = [], []
            for text in batch.column("text").to_pylist():
                ids = enc.ids(text)
                n, raw = len(ids) + 1, ids.view(np.uint8)
                lengths.append(n)
                stops = range((n - 1) % room + 1, n, room)
                at = 0
                for stop in stops:
                    crcs.append(zlib.crc32(raw[4 * at : 4 * stop]))
                    at = stop
                crcs.append(zlib.crc32(end, zlib.crc32(raw[4 * at :])))
            n = np.array(lengths, np.int64)
            count = -(-n // room)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
            first = (n - (count - 1) * room)[doc]
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(doc)),
                "row": batch.column("row").take(pa.array(doc)),
                "piece": piece.astype(np.int32),
                "start": np.where(piece == 0, 0, first + (piece - 1) * room),
                "length": np.where(piece == 0, first, room),
                "ids_crc32": np.array(crcs, np.int64),
            }
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return text_batches(rows).mapInArrow(cut, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def _pack_group(room: int, round_no: int):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["length"].to_numpy()
        bins, offs, made = best_fit_decreasing(sizes, room)
        had = pdf["bin"].nunique() if round_no else made
        if round_no and made >= had:  # nothing saved: the old bins stay
            pdf["gap"] = False
            pdf["grp"] = -1
            return pdf
        fill = np.bincount(bins, weights=sizes, minlength=made)
        gap = made > dff_bound(sizes, room)
        # bin numbers: unlike any other round's and group's
        pdf["bin"] = (np.int64(round_no) << 58) | (np.int64(key[0]) << 28) | bins
        pdf["offset"] = offs
        pdf["gap"] = gap & (fill[bins] < room)
        pdf["grp"] = int(key[0])
        return pdf

    return pack


def pack_pieces(pieces: DataFrame, room: int = ROOM, each: int = PIECES_EACH) -> DataFrame:
    """``pieces`` (row, piece, length, ...) with sequence_id and offset."""
    columns = pieces.columns
    full = pieces.where(F.col("length") == room)
    rest = pieces.where(F.col("length") < room)
    groups = groups_for(rest.count(), each)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pieces.schema)}, bin long, offset long, gap boolean, grp long"
    state = rest.withColumns({"bin": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "gap": F.lit(False), "grp": F.pmod(F.xxhash64("row", "piece"), F.lit(groups))})
    names = [*columns, "bin", "offset", "gap", "grp"]
    state = stage(state.select(names).groupBy("grp").applyInPandas(_pack_group(room, 0), schema), "pack-0")
    done = []
    for k in itertools.count(1):
        pool = state.where("gap")
        n = pool.count()
        done.append(state.where("not gap"))
        if not n or k > ROUNDS:
            done += [pool] if n else []
            break
        groups = groups_for(n, each)
        pool = pool.withColumn("grp", F.pmod(F.xxhash64("bin", F.lit(k)), F.lit(groups))).select(names)
        state = stage(pool.groupBy("grp").applyInPandas(_pack_group(room, k), schema), f"pack-{k}")
    packed = done[0]
    for more in done[1:]:
        packed = packed.union(more)
    packed = packed.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    alone = full.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(alone)


def pack_documents(docs: DataFrame, vocab: str | None = None, room: int = ROOM, each: int = PIECES_EACH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    pieces = stage(token_pieces(docs, vocab or vocabulary(), room=room), "pack-pieces")
    return pack_pieces(pieces, room, each).select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


