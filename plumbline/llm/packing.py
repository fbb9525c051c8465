"""Best-fit packing of tokenised documents into sequences, by bin completion.

A document's ids, ended by the end token, are one piece; longer ones are cut from the end into pieces of the capacity, so only
the first may be shorter. Pieces of equal length are alike, so what is packed is the histogram of lengths, of as many rows as
the capacity at most whatever the corpus: a filling found once is used as often as its lengths last.

Bin completion: the largest piece left opens a sequence, the undominated fillings of what it leaves (no other one holds the
same pieces or larger in their place) are its branches, least waste first. A branch is cut off where the sequences used and a
bound on those still needed (Martello and Toth's second: pieces over half fill sequences of their own, and only what they leave
can take the rest) reach the incumbent. Best fit, largest first, is the first incumbent. The search ends at `NODES` nodes, at the
bound, or when all is searched; it sees counts only, so it costs the same for any corpus.

Then every piece gets a rank among its length's, and ranks are dealt to the fillings' places by a range join. Ranks are made in
blocks, salted by a hash of the row, so a length that most rows share is not gathered anywhere.

Null text is empty: one piece, the end token. Repeated rows are packed each for itself; ties among equal rows are
interchangeable. Very long texts are tokenised whole. A null doc_id stays null. Empty tables give no rows. Extra columns are
ignored by `cut_pieces`, kept by `pack`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytebpe import Encoder, file_facts
from .common import broadcast_if_small, fresh, stage_table

CAPACITY = 1024
#: nodes of the search, and fillings tried at each
NODES, BRANCHES = 4_000, 4
#: rows ranked together: this many, or a 2,048th of all if that is less
RANK_BLOCK, RANK_BLOCKS = 65_536, 2_048
BROADCAST_BLOCKS = 100_000
Pattern = tuple[tuple[int, int], ...]


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs. counts[l]: pieces of length l."""
    cap = len(counts) - 1
    length = np.arange(cap + 1)
    number, words = np.cumsum(counts), np.cumsum(counts * length)
    a = np.arange(cap // 2 + 1)
    over, half = number[-1] - number[cap - a], cap // 2
    large, large_words = number[cap - a] - number[half], words[cap - a] - words[half]
    small_words = words[half] - np.where(a > 0, words[np.maximum(a - 1, 0)], 0)
    return int(max(np.max(over + large + np.maximum(0, -((large * cap - large_words - small_words) // cap))), -(-words[-1] // cap)))


def best_fit(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Best fit, largest first: (pattern, copies). Pieces of a length are placed together."""
    cap = len(counts) - 1
    open_: list[list[tuple[Pattern, int]]] = [[] for _ in range(cap + 1)]
    for size in range(cap, 0, -1):
        left = int(counts[size])
        while left:
            room = next((r for r in range(size, cap) if open_[r]), cap)
            pattern, copies = open_[room].pop() if room < cap else ((), left)
            each = room // size
            whole = min(copies, left // each)
            if whole:
                open_[room - each * size].append(((*pattern, (size, each)), whole))
                left, copies = left - whole * each, copies - whole
            if copies and left and left < each:
                open_[room - left * size].append(((*pattern, (size, left)), 1))
                left, copies = 0, copies - 1
            if copies and pattern:
                open_[room].append((pattern, copies))
    return [found for groups in open_ for found in groups]


def fillings(counts: np.ndarray, room: int) -> list[list[int]]:
    """Undominated ways to fill room with at most three pieces besides the largest that surely fit, least waste first."""
    length = np.arange(len(counts))
    fit = np.maximum.accumulate(np.where(counts > 0, length, 0))  # the largest piece of at most that length
    taken: list[int] = []
    counts = counts.copy()
    while room and fit[room] and room > 3 * fit[room]:
        size = int(fit[room])
        times = min(int(counts[size]), -(-(room - 3 * size) // size))
        taken += [size] * times
        room, counts[size] = room - times * size, counts[size] - times
        fit = np.maximum.accumulate(np.where(counts > 0, length, 0))
    best = int(fit[room])
    if best in (0, room):  # nothing fits, or one piece fills it and dominates all else
        return [[*taken, best] if best else taken]
    found = {(best,): best}
    first = np.flatnonzero(counts[: room + 1])[::-1]
    # for each first piece the largest second: smaller seconds are dominated, and so are pairs that one piece outweighs
    second = fit[np.minimum(room - first, first)]
    second = np.where((second == first) & (counts[first] < 2), fit[np.maximum(second - 1, 0)], second)
    total = first + second
    for i in np.argsort(-total, kind="stable")[:BRANCHES]:
        if second[i] and total[i] > best:
            found[int(first[i]), int(second[i])] = int(total[i])
    if max(found.values()) < room:
        tops = first[:64]
        a, b = (x[first[None, :] <= tops[:, None]] for x in np.broadcast_arrays(tops[:, None], first[None, :]))
        enough = (a + b < room) & ((a != b) | (counts[a] > 1))
        a, b = a[enough], b[enough]
        c = fit[np.minimum(room - a - b, b)]
        c = np.where(c > 0, np.where(counts[c] > (c == a).astype(int) + (c == b), c, fit[np.maximum(c - 1, 0)]), 0)
        enough = (c > 0) & (counts[c] > (c == a).astype(int) + (c == b))
        a, b, c = a[enough], b[enough], c[enough]
        for i in np.argsort(-(a + b + c), kind="stable")[:BRANCHES]:
            found[int(a[i]), int(b[i]), int(c[i])] = int(a[i] + b[i] + c[i])
    return [[*taken, *f] for f in sorted(found, key=lambda f: (-found[f], len(f)))[:BRANCHES]]


def complete_bins(counts: np.ndarray, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """(pattern, copies) of the fewest sequences found. A pattern is ((length, times), ...)."""
    cap = len(counts) - 1
    incumbent = best_fit(counts)
    best = sum(n for _, n in incumbent)
    bound = lower_bound(counts)
    # a node: what it has left, the sequences used, its branches not yet taken; steps[i] leads from node i to the next
    stack: list[tuple[np.ndarray, int, list[list[int]]]] = [(counts.astype(np.int64), 0, branches_of(counts))]
    steps: list[tuple[list[int], int]] = []
    while stack and nodes and best > bound:
        left, used, branches = stack[-1]
        if not branches:
            stack.pop()
            continue
        nodes -= 1
        filling = branches.pop(0)
        sizes, times = np.unique(filling, return_counts=True)
        copies = int(np.min(left[sizes] // times))
        after = left.copy()
        after[sizes] -= copies * times
        steps[len(stack) - 1 :] = [(filling, copies)]
        if used + copies + lower_bound(after) >= best:
            continue
        if after.any():
            stack.append((after, used + copies, branches_of(after)))
        else:
            incumbent, best = gathered(steps), used + copies
    return incumbent


def branches_of(counts: np.ndarray) -> list[list[int]]:
    """The largest piece left with each of its fillings."""
    top = int(np.max(np.flatnonzero(counts), initial=0))
    if not top:
        return []
    rest = counts.copy()
    rest[top] -= 1
    return [[top, *f] for f in fillings(rest, len(counts) - 1 - top)]


def gathered(steps: list[tuple[list[int], int]]) -> list[tuple[Pattern, int]]:
    out: dict[Pattern, int] = {}
    for filling, copies in steps:
        sizes, times = np.unique(filling, return_counts=True)
        pattern = tuple(zip(map(int, sizes[::-1]), map(int, times[::-1])))
        out[pattern] = out.get(pattern, 0) + copies
    return list(out.items())


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, unless left out, ids (array of int) of every piece of every row of docs."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    # The file and what is proven of it are as large as the vocabulary: a bounded broadcast.
    shared = docs.sparkSession.sparkContext.broadcast((model, file_facts(model)))
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # so that the ids of a batch stay few
                rows, pieces = [], []
                for doc_id, text in zip(batch.column(0)[at : at + 256].to_pylist(), batch.column(1)[at : at + 256].to_pylist()):
                    ids = encoder.encode(text or "") + end
                    total = len(ids) // 4
                    start, stop = 0, total % capacity or min(total, capacity)
                    for piece in range(-(-total // capacity)):
                        part = ids[4 * start : 4 * stop]
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(part)))
                        if with_ids:
                            pieces.append(np.frombuffer(part, "<i4"))
                        start, stop = stop, stop + capacity
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if with_ids:
                    offsets = np.cumsum([0, *map(len, pieces)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pieces), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def place_ranges(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, times, sequence, offset): ranks first to last of a length, times to a sequence, from that sequence on."""
    out, given, sequence = [], {}, 0
    for pattern, copies in patterns:
        offset = 0
        for size, times in pattern:
            first = given.get(size, 0)
            given[size] = first + times * copies
            out.append((size, first, given[size] - 1, times, sequence, offset))
            offset += size * times
        sequence += copies
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """pieces (with a column length, 1 to capacity) and sequence_id, offset. pieces: best a staged table, as it is read thrice."""
    spark = pieces.sparkSession
    blocks, block, rank, first, last, times, sequence, offset, size = fresh(pieces, "blocks", "block", "rank", "first", "last", "times", "sequence", "place", "size")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if any(not isinstance(k, int) or not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    counts = np.zeros(capacity + 1, np.int64)
    counts[list(histogram)] = list(histogram.values())
    ranges = place_ranges(complete_bins(counts, nodes))
    together = max(1, min(RANK_BLOCK, int(counts.sum()) // RANK_BLOCKS))

    parts = spark.createDataFrame([(k, -(-n // together)) for k, n in histogram.items()], f"{size} long, {blocks} long")
    own = pieces.columns
    rows = pieces.join(F.broadcast(parts), F.col("length") == F.col(size)).select(*own, F.pmod(F.xxhash64(*own), F.col(blocks)).alias(block))
    sums = rows.groupBy(F.col("length").alias(size), F.col(block).alias(first)).agg(F.count("*").alias(times))
    before = W.partitionBy(size).orderBy(first).rowsBetween(W.unboundedPreceding, -1)
    sums = stage_table(sums.select(size, first, F.coalesce(F.sum(times).over(before), F.lit(0)).alias(last)), "rank_blocks")
    simple = [F.col(f"`{c}`") for c, t in pieces.dtypes if not t.startswith(("map", "variant"))]
    rows = rows.withColumn(rank, F.row_number().over(W.partitionBy("length", block).orderBy(*simple)) - 1)
    rows = rows.join(broadcast_if_small(sums, BROADCAST_BLOCKS), (F.col("length") == F.col(size)) & (F.col(block) == F.col(first)))
    rows = rows.select(*own, (F.col(rank) + F.col(last)).alias(rank))
    places = spark.createDataFrame(ranges, f"{size} long, {first} long, {last} long, {times} long, {sequence} long, {offset} long")
    rows = rows.join(F.broadcast(places), (F.col("length") == F.col(size)) & F.col(rank).between(F.col(first), F.col(last)))
    at = F.col(rank) - F.col(first)
    return rows.select(*own, (F.col(sequence) + F.floor(at / F.col(times))).cast("long").alias("sequence_id"), (F.col(offset) + at % F.col(times) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    return pack(stage_table(cut_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids, doc_ids, lengths of each sequence, from packed pieces with ids; a group holds at most a capacity of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    each = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return each.select("sequence_id", F.aggregate("parts.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"), F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))
