"""Passages of evaluation items that turn up in texts, whole, in part, or with some words changed.

A part of at least ``min_words`` words of an item counts as leaked if a text carries it in sequence with at most one word
in ``per_change`` changed, rounded to the nearest number: a word replaced, left out or put in is one change. One rule,
:func:`allowed`, says how many changes a part of some length may have, to the filter and to the verification alike. A
leaked part keeps a known number of its word shingles, so by the prefix principle it must share one of its rarest shingles
with the text. Shingles are ordered by their rarity in the corpus, the necessary ones are joined, texts and items that are
too short are left out, pairs are bounded by the number of shingles they share at near positions, and the pairs that remain
are aligned word by word, exactly, over windows of the item's size.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashing import mix, prefix_hash, stretch_hash
from tidemark.storage import discard, materialize, ship

SHINGLE = 5
#: Up to so many item shingles (16 bytes each) are broadcast; beyond, both sides are shuffled, and a shingle that is frequent
#: among the texts is spread over so many tasks.
BROADCAST_ROWS, SALTS = 2_000_000, 16
#: Shingles whose positions differ by up to so many words are counted together.
LANE = 16

_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|\[/?[A-Za-z*][^\[\]\n]*\]")
_WORD = re.compile(r"[^\W_]+")


def allowed(words: int, per_change: int) -> int:
    """The changes that a leaked part of so many words may have."""
    return (2 * words + per_change) // (2 * per_change)


def levels(min_words: int, per_change: int) -> list[tuple[int, int, int]]:
    """(words, changes, shingles kept at least) of the parts to look for: every leaked part contains one of them.

    A leaked part of twice ``min_words`` or more has a leaked half, and one that may have no more changes than a shorter one
    contains that; so only the least lengths for each number of changes remain. A change destroys SHINGLE shingles at most.
    """
    out = []
    for words in range(min_words, 2 * min_words):
        changes = allowed(words, per_change)
        if not out or changes > out[-1][1]:
            out.append((words, changes, words - SHINGLE + 1 - SHINGLE * changes))
    if min(kept for _, _, kept in out) < 1:
        raise ValueError("so many changes may leave no shingle of a passage")
    return out


def words_of(text: str) -> list[str]:
    """The words of a text, without case, punctuation, spacing, quote marks and markup."""
    return _WORD.findall(_MARKUP.sub(" ", html.unescape(text)).lower())


def shingle_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of all runs of SHINGLE words; ``known`` keeps the words' own hashes."""
    import xxhash

    if len(words) < SHINGLE:
        return np.zeros(0, np.int64)
    codes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        codes[i] = h
    at = np.arange(len(words) - SHINGLE + 1)
    return mix(stretch_hash(prefix_hash(codes), at, at + SHINGLE)).view(np.int64)


def _shingle_rows(id_column: str, text_column: str, least: int):
    """Shingles of the texts that have at least ``least`` of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids, places, hashes = [], [], []
            if len(known) > 2_000_000:
                known.clear()
            for key, text in zip(batch.column(id_column).to_pylist(), batch.column(text_column).to_pylist(), strict=True):
                h = shingle_hashes(words_of(text), known) if text and key is not None else ()
                if len(h) >= least:
                    ids.append(np.full(len(h), key, np.int64))
                    places.append(np.arange(len(h), dtype=np.int32))
                    hashes.append(h)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, places, hashes)], [id_column, "place", "shingle"])

    return rows


def _necessary(parts: list[tuple[int, int, int]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each item, the shingles of which at least one is shared if any of its parts is leaked."""
        for batch in batches:
            for item, held in zip(batch.column("item_id").to_pylist(), batch.column("held").to_pylist(), strict=True):
                held.sort(key=lambda x: x["place"])
                rarity = sorted(range(len(held)), key=lambda i: (held[i]["seen"], held[i]["shingle"], i))
                rank = np.empty(len(held), np.int64)
                rank[rarity] = np.arange(len(held))
                need = np.zeros(len(held), bool)
                for words, _, kept in parts:
                    size = words - SHINGLE + 1
                    for start in range(len(held) - size + 1):
                        need[start + np.argsort(rank[start : start + size])[: size - kept + 1]] = True
                chosen = sorted({held[i]["shingle"] for i in np.flatnonzero(need)})
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(chosen), pa.int64()), pa.array(chosen, pa.int64())], ["item_id", "shingle"])

    return rows


def longest_passage(item: list[str], text: list[str], min_words: int, per_change: int, shifts: tuple[int, int] | None = None) -> int:
    """Words of the longest part of ``item`` of at least ``min_words`` that ``text`` carries with few enough changes, or 0.

    All alignments are tried. ``shifts``: bounds of place in the text less place in the item; an alignment that touches them
    is found wherever else it goes, as each change moves it by one at most.
    """
    n, m = len(item), len(text)
    low, high = shifts or (-n, m)
    most = allowed(n, per_change)
    low, high = max(low - most, -n), min(high + most, m)
    if n < min_words or high < low:
        return 0
    numbers = {w: i for i, w in enumerate(item)}
    kind = np.int16 if high - low < 10_000 else np.int32  # the largest sums stay below its greatest number
    far = kind(10_000)
    # the text's words at place j + d for every word j of the item and every d from low to high; -1 beyond its ends
    padded = np.full(n + high - low, -1, np.int64)
    begin, end = max(0, low), min(m, n + high)
    padded[begin - low : end - low] = [numbers.get(w, -2) for w in text[begin:end]]
    beside = np.lib.stride_tricks.sliding_window_view(padded, high - low + 1)
    step = np.where(beside == -1, far, beside != np.array([numbers[w] for w in item])[:, None]).astype(kind)
    # each word of a part that isn't changed lies within reach; most of what isn't leaked lacks too many of its words
    within = np.cumsum(np.r_[0, (step == 0).any(axis=1)])
    lengths = [w for w in range(min_words, min(2 * min_words, n + 1)) if w == min_words or allowed(w, per_change) > allowed(w - 1, per_change)]
    if not any((within[w:] - within[:-w]).max() >= w - allowed(w, per_change) for w in lengths):
        return 0
    slope = np.arange(high - low + 1, dtype=kind)
    place = low + np.arange(high - low + 1)  # of the text, at the item's first word
    best, first, block = 0, 0, 4
    # starts in blocks, from the first on, until no later one can have a longer part
    while n - first > max(best, min_words - 1):
        starts = np.arange(first, min(first + block, n))
        cost = np.full((len(starts), high - low + 1), far, kind)
        spare = (2 * (n - starts) + per_change) // (2 * per_change)
        for j in range(first, n):
            if j - first < len(starts):
                cost[j - first] = np.where((place + j >= 0) & (place + j <= m), 0, far)  # a part begins here, anywhere in the text
            after = np.minimum(cost + step[j], far)
            np.minimum(after[:, :-1], cost[:, 1:] + 1, out=after[:, :-1])  # the item's word is left out
            after -= slope
            np.minimum.accumulate(after, axis=1, out=after)  # words are put in
            after += slope
            cost = after
            least = cost.min(axis=1)
            words = j + 1 - starts
            fits = (words >= min_words) & (least <= (2 * words + per_change) // (2 * per_change))
            if fits.any():
                best = max(best, int(words[fits.argmax()]))
            if j >= starts[-1] and (least > spare).all():
                break
        first, block = first + block, 16
    return best


def _verified(min_words: int, per_change: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "passage", "shifts")]
            last, text = None, []
            for doc, item, raw, passage, shifts in zip(*columns, strict=True):
                if doc != last:
                    last, text = doc, words_of(raw)
                words = words_of(passage)
                reach = 2 * allowed(len(words), per_change)
                best, bounds = 0, []
                for low, high in sorted((x["low"], x["high"]) for x in shifts):
                    if bounds and low <= bounds[-1][1] + reach:
                        bounds[-1][1] = max(bounds[-1][1], high)
                    else:
                        bounds.append([low, high])
                for low, high in bounds:
                    best = max(best, longest_passage(words, text, min_words, per_change, (low, high)))
                if best:
                    out.append((doc, item, best))
            if out:
                doc, item, best = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, item, best)], ["doc_id", "item_id", "words"])

    return rows


def _meet(met: DataFrame, side: DataFrame, small: bool) -> DataFrame:
    """``met`` and ``side`` joined by shingle; the rows of a frequent shingle are spread over tasks by their document."""
    if small:
        return met.join(F.broadcast(side), "shingle")
    salted = met.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    return salted.join(side.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["shingle", "salt"]).drop("salt")


def find_leaks(documents: DataFrame, items: DataFrame, *, min_words: int = 25, per_change: int = 8) -> DataFrame:
    """(doc_id, item_id, words): texts of ``documents`` (doc_id, text) that leak ``items`` (item_id, passage).

    ``words`` is the length of the longest leaked part. Null and empty texts and passages, and passages of fewer than
    ``min_words`` words, leak nothing; rows with a null id are left out; an empty side gives an empty result. A passage
    listed under several items is reported for each.
    """
    ship(documents.sparkSession)
    texts, passages = documents.select("doc_id", "text"), items.select("item_id", "passage")
    parts = levels(min_words, per_change)
    kept = min(k for _, _, k in parts)
    held = materialize(
        passages.mapInArrow(_shingle_rows("item_id", "passage", min_words - SHINGLE + 1), "item_id bigint, place int, shingle bigint"), "item-shingles"
    )
    wanted = held.select("shingle").distinct()
    small = held.count() <= BROADCAST_ROWS
    if small:
        wanted = F.broadcast(wanted)
    shingles = texts.mapInArrow(_shingle_rows("doc_id", "text", kept), "doc_id bigint, place int, shingle bigint")
    met = materialize(shingles.join(wanted, "shingle", "left_semi"), "met-shingles")

    seen = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
    ranked = held.join(seen, "shingle", "left").fillna(0, ["seen"])
    per_item = ranked.groupBy("item_id").agg(F.collect_list(F.struct("place", "shingle", "seen")).alias("held"))
    necessary = materialize(per_item.mapInArrow(_necessary(parts), "item_id bigint, shingle bigint"), "necessary")
    pairs = _meet(met, necessary, small).select("doc_id", "item_id").distinct()

    # pairs must share enough shingles at positions that differ by no more than the changes allow
    shared = (
        _meet(met.withColumnRenamed("place", "at"), held, small)
        .join(pairs, ["doc_id", "item_id"], "left_semi")
        .withColumn("shift", F.col("at") - F.col("place"))
    )
    width = max(LANE, 1 + allowed(2 * min_words, per_change))
    near = shared.withColumn("lane", F.explode(F.array(F.floor(F.col("shift") / width), F.floor(F.col("shift") / width) - 1)))
    lanes = near.groupBy("doc_id", "item_id", "lane").agg(
        F.count_distinct("place").alias("n"), F.min("shift").alias("low"), F.max("shift").alias("high")
    ).where(F.col("n") >= kept)
    bounded = lanes.groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("low", "high")).alias("shifts"))
    bounded = materialize(bounded, "bounded-pairs")
    discard(held, met, necessary)
    return (
        bounded.join(texts, "doc_id")
        .join(passages, "item_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(_verified(min_words, per_change), "doc_id bigint, item_id bigint, words bigint")
        .groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
    )
