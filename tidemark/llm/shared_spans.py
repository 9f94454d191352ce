"""Long stretches that occur verbatim in more than one text.

Seeds are winnowed anchors: of all anchors of ``ANCHOR`` characters that start in a window, the one of the least hash.
Every stretch of ``span`` characters (a window) has exactly one such anchor, determined by its characters alone, so two
equal windows share their anchor. A seed stands for the run of windows that its anchor represents.

Seeds of equal anchors are joined through their groups, never in pairs: of all documents that hold a window, the least is
its reference. Where the whole run's text is equal in two documents, the run is settled. What is left, mostly the ends of
shared stretches, is looked at from the anchor both ways: first by half of the missing characters to the left or to the
right, one of which any equal window must match, then, where that succeeds, window by window, and equal windows meet by
their hashes. At last each document is laid beside the references of its windows, and the match is extended both ways,
character by character, as far as it goes: so every stretch is verbatim and maximal, and hashes only propose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.hashing import code_points, mix, prefix_hash, sliding_min, stretch_hash
from tidemark.storage import discard, materialize, ship

ANCHOR = 50
#: Bits of a position in the packed (hash, position) minima: texts of up to 2**30 characters.
POSITION_BITS = 30
#: Characters that are hashed together.
GROUP = 400_000


# the columns of a seed, all bigint; ``at`` is the first place of an equal run in its text
SEED = ("anchor", "run", "left", "right", "doc_id", "position", "first", "last", "at")
# of a window that is looked at by itself, with the run that its document stands for and its place in it
WINDOW = ("anchor", "window", "doc_id", "start", "at", "run", "rel")
STRETCH = ("doc_id", "start", "length", "other", "other_start")

#: Rows of one key beyond which it is spread over tasks, and the greatest number of keys that are.
HOT_ROWS, HOT_KEYS = 100_000, 100_000


def seeds_of(texts: list[str], span: int, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of each seed of some texts of at least ``span`` characters: (number of its text, hash of its anchor, of its run's
    text, of the anchor with half of the missing characters to the left, and to the right, the anchor's position, the
    run's first and last window, the first window of the first equal run in the text).

    Where the text ends too soon for a half the hash is 0.
    """
    size = np.array([len(t) for t in texts])
    ends = np.cumsum(size)
    begins = ends - size
    prefix = prefix_hash(code_points("".join(texts)))
    at = np.arange(ends[-1] - anchor + 1)
    hashes = stretch_hash(prefix, at, at + anchor)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    least = (sliding_min((hashes & ~mask) | at.astype(np.uint64), span - anchor + 1) & mask).astype(np.int64)
    # windows that run from one text into the next aren't any
    whole = np.ones(len(least), bool)
    for end in ends[:-1]:
        whole[max(0, end - span + 1) : end] = False
    window = np.flatnonzero(whole)
    new = np.r_[True, np.diff(least[window]) != 0]
    first, position = window[new], least[window][new]
    last = window[np.r_[np.flatnonzero(new)[1:] - 1, len(window) - 1]]
    text = np.searchsorted(ends, first, side="right")
    # the run's hash also tells where in it the anchor lies
    run = mix(stretch_hash(prefix, first, last + span) ^ mix((position - first).astype(np.uint64)))
    half = (span - anchor + 1) // 2
    low, high = position - half, position + anchor + half
    left = np.where(low >= begins[text], stretch_hash(prefix, np.maximum(low, 0), position + anchor) | np.uint64(1), np.uint64(0))
    right = np.where(high <= ends[text], stretch_hash(prefix, position, np.minimum(high, ends[-1])) | np.uint64(1), np.uint64(0))
    at = first[first_equal(text, hashes[position], run)]
    return text, hashes[position], run, left, right, *(x - begins[text] for x in (position, first, last, at))


def first_equal(*columns: np.ndarray) -> np.ndarray:
    """Of each row, the number of the first row that equals it."""
    order = np.lexsort((np.arange(len(columns[0])), *columns))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _groups(items: list[tuple], length) -> Iterator[list[tuple]]:
    """The items in groups of about GROUP characters, or single ones that are longer."""
    group, held = [], 0
    for item in items:
        group.append(item)
        held += length(item)
        if held >= GROUP:
            yield group
            group, held = [], 0
    if group:
        yield group


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _seed_rows(span: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for group in _groups([x for x in pairs if x[0] is not None and x[1] and len(x[1]) >= span], lambda x: len(x[1])):
                text, *columns = seeds_of([t for _, t in group], span)
                doc = np.array([d for d, _ in group], np.int64)[text]
                hashes, places = columns[:4], columns[4:]
                yield pa.RecordBatch.from_arrays([*map(_signed, hashes), *map(pa.array, (doc, *places))], list(SEED))

    return rows


def _window_rows(span: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "todo")), strict=True))
            for group in _groups(rows, lambda x: len(x[1])):
                begin, todo, runs = 0, [], []
                for doc, text, seeds in group:
                    seeds.sort(key=lambda x: x["first"])
                    todo += [(x["anchor"], doc, begin, begin + x["first"], x["last"] - x["first"] + 1, x["base"]) for x in seeds]
                    runs += [x["run"] for x in seeds]
                    begin += len(text)
                prefix = prefix_hash(code_points("".join(text for _, text, _ in group)))
                anchor, doc, begin, first, size, base = (np.array(x, np.int64) for x in zip(*todo, strict=True))
                start = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                window = stretch_hash(prefix, start, start + span)
                place = start - np.repeat(begin, size)
                run = pa.array(runs, pa.int64()).take(pa.array(np.repeat(np.arange(len(runs)), size)))
                anchor, doc = np.repeat(anchor, size), np.repeat(doc, size)
                at = place[first_equal(doc, anchor, window)]  # places of a text ascend, so that is the first
                rel = place - np.repeat(base, size)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), _signed(window), *map(pa.array, (doc, place, at)), run, pa.array(rel)], list(WINDOW))

    return rows


def _extended(span: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each pair of texts, the maximal equal stretches on the diagonals that seeds lie on."""
        for batch in batches:
            out = []
            for doc, text, other, beside, diagonals in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "other", "beside", "diagonals")), strict=True):
                mine, theirs = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text, beside))
                for diagonal in diagonals:
                    offset, starts = diagonal["offset"], np.array(diagonal["starts"])
                    low, high = max(0, -offset), min(len(mine), len(theirs) - offset)
                    if high - low < span:
                        continue
                    equal = np.zeros(high - low + 2, bool)
                    equal[1:-1] = mine[low:high] == theirs[low + offset : high + offset]
                    turns = low + np.flatnonzero(equal[1:] != equal[:-1])
                    begin, end = turns[::2], turns[1::2]
                    at = np.searchsorted(begin, starts, side="right") - 1
                    held = np.unique(at[(at >= 0) & (starts + span <= end[at])])
                    out += [(doc, begin[i], end[i] - begin[i], other, begin[i] + offset) for i in held]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*out, strict=True)], list(STRETCH))

    return rows


def _bigints(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} bigint" for n in names)


def _spread_join(many: DataFrame, few: DataFrame, keys: list[str], limit: int | None, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``, which has one row per key or so and ``n``, the rows of ``many`` with that key.

    Keys of more than ``limit`` rows are spread over tasks by a salt. They are told by a broadcast table of HOT_KEYS rows at
    most, as the limit is at least that part of all rows. Without a limit no key is that frequent.
    """
    if limit is None:
        return many.join(few.drop("n"), keys, how)
    salts = F.when(F.col("n") > limit, F.ceil(F.col("n") / limit)).otherwise(1)
    hot = few.where(F.col("n") > limit).select(*keys, salts.alias("salts")).distinct()
    salted = many.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1)))).drop("salts")
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("n")
    return salted.join(copies, [*keys, "salt"], how).drop("salt")


def _limit(few: DataFrame) -> int | None:
    """Rows beyond which a key of ``few`` (with ``n`` rows each) is spread, or None if none has so many."""
    most, total = few.agg(F.max("n"), F.sum("n")).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    return limit if (most or 0) > limit else None


def _ends() -> tuple[Column, ...]:
    """Aggregates that tell a group by its least and its greatest document, each with its first place there."""
    return F.min("doc_id").alias("low"), F.min_by("at", "doc_id").alias("low_at"), F.max("doc_id").alias("high"), F.max_by("at", "doc_id").alias("high_at")


def _partner() -> tuple[Column, Column]:
    """(other, its place) for a row of a group: the reference, or for the reference itself the greatest document."""
    own = F.col("doc_id") == F.col("low")
    return F.when(own, F.col("high")).otherwise(F.col("low")), F.when(own, F.col("high_at")).otherwise(F.col("low_at"))


def matched_diagonals(documents: DataFrame, span: int = 150) -> tuple[DataFrame, DataFrame]:
    """(doc_id, other, offset, start), and the texts (doc_id, text) of all documents in it: of every window that occurs in two documents, the diagonal on which it matches its
    reference, the least document that holds it (for the reference itself, the greatest), at its first place there.

    ``offset`` is the place there less the place here. Windows of one anchor on one diagonal have one row, with the first.
    """
    ship(documents.sparkSession)
    texts = documents.select("doc_id", "text")
    seeds = materialize(texts.mapInArrow(_seed_rows(span), _bigints(SEED)), "seeds")
    # groups are told by their least and greatest document, combined on the map side: frequent ones do no harm
    low_high = (F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    anchors = materialize(seeds.groupBy("anchor").agg(*low_high).where("low < high").select("anchor", "n"), "anchors")
    limit = _limit(anchors)  # runs, halves and windows of an anchor are no more than its seeds
    joined = materialize(_spread_join(seeds, anchors, ["anchor"], limit), "joined-seeds")
    discard(seeds, anchors)

    runs = materialize(joined.groupBy("anchor", "run").agg(*_ends(), F.count(F.lit(1)).alias("n")), "runs")
    several = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("open"))
    wanted = runs.join(several, "anchor", "left").where("low < high or open")
    judged = materialize(_spread_join(joined, wanted, ["anchor", "run"], limit), "judged-seeds")
    discard(joined)
    # from here on only texts that may share something are moved
    texts = materialize(texts.join(judged.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
    other, place = _partner()
    closed = judged.where("low < high and open is null").select("doc_id", other.alias("other"), (place - F.col("first")).alias("offset"), F.col("first").alias("start"))

    # of a settled run two documents stand for all; runs of one document are all looked at
    leads = (F.col("low") < F.col("high")) & (F.col("doc_id") == F.col("low")) & (F.col("first") == F.col("low_at"))
    todo = judged.where("open and (doc_id = low or doc_id = high)").withColumn("led", F.when(leads, F.col("run")))
    todo = todo.select("doc_id", "anchor", "left", "right", "position", "first", "last", "led")
    half = (span - ANCHOR + 1) // 2
    for side in ("left", "right"):
        met = todo.where(F.col(side) != 0).groupBy("anchor", side).agg(*low_high).where("low < high")
        todo = _spread_join(todo, met.select("anchor", side, "n", F.lit(True).alias(f"met_{side}")), ["anchor", side], limit, "left")
    # windows that begin half or more before the anchor hold its left half, those that begin half or less before its right
    nearest = F.when(F.col("met_right"), F.col("last")).otherwise(F.least("last", F.col("position") - half))
    farthest = F.when(F.col("met_left"), F.col("first")).otherwise(F.greatest("first", F.col("position") - (span - ANCHOR - half)))
    todo = todo.where("met_left or met_right").select(
        "doc_id", "anchor", F.col("led").alias("run"), F.col("first").alias("base"), farthest.alias("first"), nearest.alias("last")
    ).where("first <= last")
    by_doc = todo.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "run", "base", "first", "last")).alias("todo"))
    windows = materialize(by_doc.join(texts, "doc_id").mapInArrow(_window_rows(span), _bigints(WINDOW)), "windows")
    equal = windows.groupBy("anchor", "window").agg(*_ends(), F.count(F.lit(1)).alias("n")).where("low < high")
    met = _spread_join(windows, equal, ["anchor", "window"], limit)
    led = F.col("run").isNotNull()
    met = met.groupBy(
        "doc_id", "anchor", "run", other.alias("other"), (place - F.col("start")).alias("offset"),
        F.when(led, F.col("low")).alias("low"), F.when(led, F.col("low_at") - F.col("rel")).alias("delta"),
    ).agg(F.min("start").alias("start"), F.min("rel").alias("rel"))
    met = materialize(met, "met-windows")
    looked = met.select("doc_id", "other", "offset", "start")

    # what the windows of the document that stands for a run have met holds for all documents of the run
    pieces = met.where("run is not null").groupBy("anchor", "run", F.col("low").alias("other"), "delta").agg(F.min("rel").alias("rel"))
    pieces = pieces.join(runs.select("anchor", "run", "n"), ["anchor", "run"])
    rest = judged.where("open and low < high and doc_id != low and doc_id != high").select("doc_id", "anchor", "run", "first")
    followed = _spread_join(rest, pieces, ["anchor", "run"], limit).select(
        "doc_id", "other", (F.col("delta") - F.col("first")).alias("offset"), (F.col("first") + F.col("rel")).alias("start")
    )
    diagonals = materialize(closed.unionByName(looked).unionByName(followed), "diagonals")
    discard(runs, judged, windows, met)
    return diagonals, texts


def shared_stretches(documents: DataFrame, span: int = 150) -> DataFrame:
    """(doc_id, start, length, other, other_start, class_id): stretches of ``span`` or more characters found in other documents.

    Characters are code points, compared exactly. A stretch is equal to the one of the same length at ``other_start`` in
    ``other``, and can't be longer on either side. Every ``span`` characters (a window) that occur in another document lie
    in a stretch shared with the window's reference, the least document that holds it, where it occurs first; the reference's
    own windows, with the greatest document. ``class_id`` is that reference, so all documents that share a window meet at
    the same place of one document, and no link is lost though copies aren't paired with each other. Stretches of a document
    may overlap. Null and shorter texts share nothing; rows with a null ``doc_id`` are left out; a repeated ``doc_id``
    counts as one document; an empty input gives an empty result.
    """
    diagonals, texts = matched_diagonals(documents, span)
    lines = diagonals.groupBy("doc_id", "other", "offset").agg(F.collect_set("start").alias("starts"))
    pairs = materialize(lines.groupBy("doc_id", "other").agg(F.collect_list(F.struct("offset", "starts")).alias("diagonals")), "pairs")
    discard(diagonals)
    partners = pairs.groupBy("other").agg(F.count(F.lit(1)).alias("n"))
    beside = texts.withColumnsRenamed({"doc_id": "other", "text": "beside"}).join(partners, "other")
    both = _spread_join(pairs.join(texts, "doc_id"), beside, ["other"], _limit(partners))
    found = both.select("doc_id", "text", "other", "beside", "diagonals").mapInArrow(_extended(span), _bigints(STRETCH)).distinct()
    return found.withColumn("class_id", F.least("doc_id", "other"))


def shared_parts(documents: DataFrame, span: int = 150) -> DataFrame:
    """(doc_id, n_chars, shared_chars, stretches, links) of every document with a text: how much of it is found in others.

    ``links`` is the number of documents named by its stretches; all others that share with it are linked to those.
    """
    order = Window.partitionBy("doc_id").orderBy("start")
    stretches = shared_stretches(documents, span).withColumn("stop", F.col("start") + F.col("length"))
    reached = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("start"))
    fresh = F.greatest(F.col("stop") - F.greatest("start", reached), F.lit(0))
    held = stretches.withColumn("fresh", fresh).groupBy("doc_id").agg(
        F.sum("fresh").alias("shared_chars"), F.count(F.lit(1)).alias("stretches"), F.count_distinct("other").alias("links")
    )
    lengths = documents.where("text is not null and doc_id is not null").select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"))
    return lengths.join(held, "doc_id", "left").fillna(0, ["shared_chars", "stretches", "links"])
