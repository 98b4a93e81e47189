"""Best-fit packing of tokenized documents into sequences of bounded length.

The number of pieces of each length, at most ``capacity`` counts, is all that the driver gets.  On it
the configuration linear program (as few sequences as possible, each filled by one of all possible
combinations of lengths, so that every length is covered) is solved by multiplicative weights: a
length's price falls exponentially with the share of its pieces that is covered; the best combination
at these prices is found by a knapsack dynamic program; it gets a step that covers at most ``step`` of
any length.  Whole multiples are kept (rounding down, never beyond the pieces there are);
the remaining pieces go to the fullest sequence that takes them, longest first (best fit).  Rounding costs most
where counts are small, so best fit alone is planned too, and the plan with fewest sequences is taken.

The plan lists, for each length, runs of pieces with their sequences: its size depends on the
capacity and the steps, not on the number of documents.  A piece's rank among those of its length comes
from range partitions and prefix sums of their counts, as a length may be that of a third of all pieces.

Defined results.  Null text: empty, one piece holding id 0 only.  Null or repeated ids, repeated
rows: each row is a document of its own.  Empty table: empty result.  Extra columns: ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordTokens
from .common import Workspace, small_batches

_tokenizers: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents' ids, ``end_id`` last, cut only where they are longer than a sequence."""
    small_batches(docs.sparkSession)
    last = int(end_id).to_bytes(4, "little")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokens(tokenizer_path)
        tokens = _tokenizers[tokenizer_path]
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, own in enumerate(tokens.texts(batch.column(1))):
                raw = own.astype("<u4", copy=False).tobytes() + last
                n = len(raw) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = raw[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (i, piece, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            rows, *rest = out
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, kind) for x, kind in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        task, "doc_id long, piece int, start long, length long, ids_crc32 long")


#: Pieces shorter than this part of a sequence are left to best fit, which closes the last gaps with them.
SAND = 32

Configuration = tuple[int, ...]


def knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to len(price) - 1 the highest price of lengths that it takes, and one of these lengths (0: leave a place empty)."""
    capacity = len(price) - 1
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    own = price[1:]
    for c in range(1, capacity + 1):
        v = own[:c] + best[c - 1 :: -1] if c > 1 else own[:1] + best[:1]
        j = int(v.argmax())
        if v[j] > best[c - 1]:
            best[c], choice[c] = v[j], j + 1
        else:
            best[c] = best[c - 1]
    return best, choice


def filled(choice: list[int], room: int) -> Configuration:
    """The lengths that ``knapsack`` puts into this room."""
    out = []
    while room > 0:
        if choice[room]:
            out.append(choice[room])
        room -= choice[room] or 1
    return tuple(out)


def solve(counts: np.ndarray, *, step: float = 0.25, sharpness: float = 6.0, tables: int = 60, batch: int = 128, slack: float = 0.1) -> list[tuple[Configuration, float]]:
    """Fractional configurations for counts (by length, 0 unused), by multiplicative weights.

    A dynamic program at the current prices serves ``batch`` steps: for each of the lengths that lag most, the best
    combination with it, if its price is within ``slack`` of the best of all.
    """
    size, capacity = np.arange(len(counts)), len(counts) - 1
    some = counts > 0
    covered = np.zeros(len(counts))
    found: dict[Configuration, float] = {}
    for _ in range(tables):
        open_ = some & (covered < 1 - 1e-9)
        if not open_.any():
            break
        # by size, as a token of any length is worth the same; lengths that lag behind gain
        price = np.where(open_, size * np.exp(-sharpness * (covered - covered[open_].min())), 0.0)
        best, choice = knapsack(price)
        chosen, moved = choice.tolist(), False
        lagging = np.lexsort((-size, covered))
        for n in lagging[open_[lagging]][:batch].tolist():
            if price[n] + best[capacity - n] < (1 - slack) * best[capacity]:
                continue
            a = tuple(sorted((n, *filled(chosen, capacity - n)), reverse=True))
            times = Counter(a)
            x = min(min(step, 1 - covered[l]) * counts[l] / k for l, k in times.items())
            if x < 1e-9:
                continue
            for l, k in times.items():
                covered[l] += k * x / counts[l]
            found[a] = found.get(a, 0.0) + x
            moved = True
        if not moved:
            break
    return list(found.items())


def plan(counts: np.ndarray, *, rests: tuple[float, ...] = (0.02, 0.1, 0.25), turns: int = 12) -> tuple[list[tuple[Configuration, int]], int, int]:
    """Groups of equal sequences (lengths in order, how many), the number of all sequences, and of those that the program gave.

    The program's configurations are taken in whole numbers, those of full sequences at least once while there are pieces for them; it is
    solved again for the pieces that are left, until it takes no more of them or few are left, which best fit places:
    the least of the shares ``rests`` with the fewest sequences.  If best fit alone needs fewer, its plan is taken.
    """
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    taken: list[tuple[Configuration, int]] = []
    if left[capacity]:  # a piece that fills a sequence stands alone
        taken.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    start, total, given, made = left.copy(), left.sum(), 0, []
    sand = np.arange(capacity + 1) < capacity // SAND
    for share in sorted(rests, reverse=True):
        for turn in range(turns):
            before = left.sum()
            for a, x in sorted(solve(np.where(sand, 0, left), step=1.0 if turn or made else 0.25), key=lambda p: -p[1]):
                times = Counter(a)
                whole = int(x + 1e-9) if sum(a) < capacity and not turn else max(1, int(x + 1e-9)) if sum(a) == capacity else 0
                k = min(whole, *(int(left[l]) // m for l, m in times.items()))
                if k > 0 and left.sum() > share * total:
                    for l, m in times.items():
                        left[l] -= k * m
                    given += k
                    taken.append((a, k))
            if left.sum() in (0, before) or left.sum() <= share * total:
                break
        groups = best_fit(left, taken)
        made.append((sum(k for _, k in groups), -given, groups))
    n, given, groups = min(made, key=lambda x: x[:2])
    alone = best_fit(start, [((capacity,), int(counts[capacity]))] if counts[capacity] else [])
    n_alone = sum(k for _, k in alone)
    return (groups, n, -given) if n <= n_alone else (alone, n_alone, 0)


def best_fit(counts: np.ndarray, groups: list[tuple[Configuration, int]]) -> list[tuple[Configuration, int]]:
    """Groups of sequences with the counted pieces added, longest first, each to the fullest sequence that takes it."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64)
    slack: list[list] = [[] for _ in range(capacity + 1)]
    for content, k in groups:
        slack[capacity - sum(content)].append((content, k))
    free = {s for s in range(1, capacity + 1) if slack[s]}
    for l in range(capacity, 0, -1):
        n = int(left[l])
        while n:
            s = min((s for s in free if s >= l), default=None)
            if s is None:
                each = capacity // l
                made = max(1, n // each)
                content = (l,) * min(each, n)
                group = (content, made)
                n -= made * len(content)
                s_new = capacity - l * len(content)
            else:
                content, k = slack[s].pop()
                take = min(k, n)
                if take < k:
                    slack[s].append((content, k - take))
                if not slack[s]:
                    free.discard(s)
                group, s_new = ((*content, l), take), s - l
                n -= take
            slack[s_new].append(group)
            if s_new:
                free.add(s_new)
    return [g for x in slack for g in x]


def placements(groups: list[tuple[Configuration, int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For each length, runs of its pieces: first place (over all lengths in turn), sequence of the first, offset; and each length's first place."""
    by: list[list] = [[] for _ in range(capacity + 1)]
    first = 0
    for content, k in groups:
        offset = 0
        for l in content:
            by[l].append((k, first, offset))
            offset += l
        first += k
    at, place, begins = 0, [], np.zeros(capacity + 2, np.int64)
    for l, runs in enumerate(by):
        begins[l] = at
        for k, sequence, offset in runs:
            place.append((at, sequence, offset))
            at += k
    begins[capacity + 1] = at
    rows = np.array(place, np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2], begins


def pack(parts: DataFrame, *, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """parts (with length, 1 to capacity) with sequence_id and offset."""
    spark = parts.sparkSession
    small_batches(spark, 10_000)
    work = Workspace(spark, "pack")
    parts = work.save(parts, "given")  # range partitioning reads its input twice
    ranged = parts.repartitionByRange("length", *order).withColumn("part", F.spark_partition_id())
    rows = work.save(ranged, "parts")
    work.drop("given")
    sums = work.save(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "sums")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sums.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    firsts, sequences, offsets, begins = placements(plan(counts)[0], capacity)

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    sums = sums.select(F.col("length").alias("l"), F.col("part").alias("p"), "before")
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1
    ranked = rows.withColumn("rank", rank).join(sums, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p")))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("l", "p", "before", "part")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            place = begins[length] + at
            run = np.searchsorted(firsts, place, side="right") - 1
            kept = batch.select([c for c in batch.schema.names if c != "rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequences[run] + place - firsts[run]), pa.array(offsets[run])], names=[*kept.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(task, schema)
