"""Filling containers of fixed capacity with texts.

Texts are measured in tokens of a public tokenizer. All that a packing depends on is how many pieces there are of each
size, a table bounded by the capacity, so the packing itself is found on that table: small sets that provably dominate
all alternatives are fixed for good (Martello and Toth's reduction), and what is left is packed best-fit by decreasing
size. The pieces then take their places by their rank among the pieces of their size, in parallel.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import materialize, ship

# Fixed value: the split pattern that belongs to the public byte-level vocabulary.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: White space of so many characters in a row is more than the tokenizer's own splitting can take.
BLANKS = 50_000

Pattern = tuple[int, tuple[tuple[int, int], ...]]


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, encoder) -> int:
    """Tokens of a whole text, however long."""
    if len(text) < BLANKS or not re.search(rf"\s{{{BLANKS}}}", text):
        return len(encoder.encode_ordinary(text))
    import regex

    # split by the same pattern, but piece by piece
    return sum(len(encoder._encode_single_piece(x)) for x in regex.findall(SPLIT_PATTERN, text))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens); a null text has no tokens, as an empty one. The vocabulary's file is sent to the executors."""
    spark = documents.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(SparkFiles.get(name))
        for batch in batches:
            sizes = [count_tokens(text, encoder) if text else 0 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    ship(spark)
    return documents.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix sets of up to three sizes that dominate every other way to fill a container with their first member.

    ``counts[s]`` is the number of pieces of size s and is lowered in place. A set dominates another if the other's
    members can be laid into its own; fixing it can't cost a container.
    """
    fixed: list[Pattern] = []

    def fix(times: int, *sizes: int) -> None:
        for s in sizes:
            counts[s] -= times
        fixed.append((times, tuple((s, sizes.count(s)) for s in dict.fromkeys(sizes))))

    for j in range(capacity, 0, -1):
        while counts[j] > 0:
            room = capacity - j
            others = counts[: room + 1].copy()
            if j <= room:
                others[j] -= 1
            sizes = np.flatnonzero(others[1:]) + 1
            if not len(sizes):
                # nothing fits beside it
                fix(int(counts[j]), j)
                continue
            k = int(sizes[-1])
            small = np.repeat(sizes[:3], np.minimum(others[sizes[:3]], 3))[:3]
            together = int(counts[j] // 2) if k == j else int(min(counts[j], counts[k]))
            if k == room or len(small) < 2 or small[0] + small[1] > room:
                # either it fills the container, or no two pieces fit: the largest single one dominates
                fix(together, j, k)
                continue
            if len(small) == 3 and small.sum() <= room:
                break  # four and more may share a container: no small set is provably best
            pairs = sizes[:, None] + sizes[None, :]
            pairs[np.arange(len(sizes)), np.arange(len(sizes))] = np.where(others[sizes] > 1, 2 * sizes, room + 1)
            fits = pairs <= room
            if pairs[fits].max() <= k:
                fix(together, j, k)
                continue
            beside = sizes[fits[-1]]
            if not len(beside) or np.minimum(sizes[:, None], sizes[None, :])[fits].max() > beside[-1]:
                break
            b = int(beside[-1])
            fix(min(int(counts[s]) // (j, k, b).count(s) for s in (j, k, b)), j, k, b)
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Pack what is left, largest first, each piece into the fullest container that takes it; equal ones at once."""
    open_: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            room = min((r for r in open_ if r >= s), default=capacity)
            number, held = open_[room].pop() if room in open_ else (left, ())
            if room in open_ and not open_[room]:
                del open_[room]
            each = room // s
            full = min(number, left // each)
            if full:
                open_.setdefault(room - each * s, []).append((full, (*held, (s, each))))
                left -= full * each
            rest = number - full
            if rest and left and left < each:
                open_.setdefault(room - left * s, []).append((1, (*held, (s, left))))
                left, rest = 0, rest - 1
            if rest and held:
                open_.setdefault(room, []).append((rest, held))
    counts[1:] = 0
    return [x for group in open_.values() for x in group]


def pack_sizes(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """(how many containers, ((size, pieces in each), ...)) for all pieces; ``counts`` is left as it was."""
    left = counts.copy()
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def _places(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Runs of places sorted by (size, first rank): rank r of a size lies in container base + (r - first) // each."""
    taken = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for times, parts in patterns:
        for size, each in parts:
            rows.append((size, taken[size], base, each))
            taken[size] += times * each
        base += times
    rows.sort()
    size, first, start, each = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ((), (), (), ())))
    return {"size": size, "first": first, "base": start, "each": each}


def pieces_of(tokens: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, token_from, n_tokens): a text is one piece, or cut at multiples of the capacity if it exceeds it."""
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0))
    return tokens.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).select(
        "doc_id", "part", (F.col("part") * capacity).alias("token_from"),
        F.least(F.col("n_tokens") - F.col("part") * capacity, F.lit(capacity)).alias("n_tokens"),
    )


def assign_containers(tokens: DataFrame, capacity: int = 2048, rows_per_task: int = 2_000_000) -> DataFrame:
    """(doc_id, part, token_from, n_tokens, container_id) for all texts of ``tokens`` (doc_id, n_tokens).

    No container holds more than ``capacity`` tokens and only a text beyond the capacity is cut. Texts without tokens
    take no room and lie in container 0. Repeated rows are packed as often as they occur; an empty input gives an
    empty result. The table of sizes has at most ``capacity`` rows, whatever the input, and is all that the driver sees.
    """
    ship(tokens.sparkSession)
    pieces = materialize(pieces_of(tokens, capacity), "pieces")
    table = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in table:
        counts[row["n_tokens"]] = row["n"]
    places = _places(pack_sizes(counts, capacity), capacity)

    # ranks within a size; frequent sizes are split by a salt so that no task numbers more than its share
    salts = max(1, -(-int(counts.sum()) // rows_per_task))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)))
    held = salted.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("n_tokens", "salt", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "part")
    ranked = (
        salted.withColumn("own", F.row_number().over(own) - 1)
        .join(materialize(offsets, "size-offsets"), ["n_tokens", "salt"])
        .select("doc_id", "part", "token_from", "n_tokens", (F.col("offset") + F.col("own")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 48
        keys = (places["size"] << bits) | places["first"]
        for batch in batches:
            size, rank = batch.column("n_tokens").to_numpy(), batch.column("rank").to_numpy()
            container = np.zeros(len(size), np.int64)
            if len(keys):
                at = np.searchsorted(keys, (size << bits) | rank, side="right") - 1
                found = places["base"][at] + (rank - places["first"][at]) // places["each"][at]
                container = np.where(size > 0, found, 0)
            columns = [batch.column(c) for c in ("doc_id", "part", "token_from", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(container)], ["doc_id", "part", "token_from", "n_tokens", "container_id"])

    return ranked.mapInArrow(place, "doc_id bigint, part bigint, token_from bigint, n_tokens bigint, container_id bigint")
