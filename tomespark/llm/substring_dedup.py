"""Substring dedup: passages that an earlier document already has are cut out.

A window is WINDOW consecutive words of one document, and every window has a
Rabin-Karp hash. A word goes when a window over it has a word sequence that also
starts in a document with a smaller ``doc_id``.

Shuffling a hash for every window would move several times the input, so windows
travel in runs. Each window is anchored at the leftmost of its ANCHOR-word runs
with the smallest hash, which depends on the window's own words alone: equal
windows have equal anchors at equal offsets. Neighbouring windows with one
anchor make a run, about one for every eighteen windows.

1. Spark keeps the anchors that more than one run content or document has. A
   window whose anchor is alone in the corpus cannot repeat.
2. Runs of equal content (a second hash, over all words of the run) are counted
   as one: the smallest doc_id that has the run owns it, and in every other
   document all its windows are repeats.
3. Windows of owned runs whose anchor has other contents as well are hashed one
   by one (two Rabin-Karp hashes, 128 bits) and Spark takes the smallest doc_id
   of each.
4. Per document, repeated windows merge into maximal intervals, which are cut.

Runs are hashed once and written. Grouping always combines before the shuffle.
Where runs are joined back to their anchors and contents, those that are in many
runs (a passage that a third of all texts hold) are counted and joined by
broadcast, and all others by a shuffle. A text is joined to its own spans only.

Long texts are hashed in segments of SEGMENT windows; a run that a segment's end
cuts in two is settled by steps 2 and 3 like any other.

Defined cases: a null or empty text has no words. Very long texts are read whole.
A row with a null ``doc_id`` loses nothing and takes nothing from others. Rows
with equal doc_id do not cut each other, and each repeated row is cut alike; with
equal doc_id there is no smaller one (a tie). Repeats within one document stay.
An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomespark.llm.common import join_counted, stash
from tomespark.llm.hashing import Rolling, mix, word_bounds, word_hashes

WINDOW = 50
ANCHOR = 16
SEGMENT = 1 << 18

_RUN_FIELDS = "anchor long, content long, doc_id long, text_key long, first long, size int"
_OUT_FIELDS = "doc_id long, kept_text string, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>"


def _raw(text: pa.Scalar) -> bytes:
    buffer = text.as_buffer() if text.is_valid else None
    return buffer.to_pybytes() if buffer is not None else b""


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def runs_of(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows: anchor hash, content hash, first window and number of windows."""
    found = []
    for begin in range(0, len(hashes) - window + 1, SEGMENT):
        part = hashes[begin : begin + SEGMENT + window - 1]
        anchors = Rolling(part).windows(anchor)
        at = sliding_window_view(anchors, window - anchor + 1).argmin(axis=1)
        at += np.arange(len(at))
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        size = np.diff(np.concatenate((first, [len(at)])))
        place = at[first]
        shape = ((place - first) * (window + 1) + size).astype(np.uint64)
        content = mix(Rolling(part, 1).runs(first, first + size + window - 1) ^ mix(shape))
        found.append((anchors[place], content, first + begin, size))
    return tuple(np.concatenate(x) for x in zip(*found))


def _emit_runs(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            held = 0
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text")):
                hashes = word_hashes(_raw(text))
                if doc is None or len(hashes) < window:
                    continue
                keys, content, first, size = runs_of(hashes, window, anchor)
                parts.append([keys, content, np.full(len(first), doc, np.int64), np.full(len(first), key, np.int64), first.astype(np.int64), size.astype(np.int32)])
                held += len(first)
                if held > 200_000:
                    yield _as_runs(parts)
                    parts, held = [], 0
            if parts:
                yield _as_runs(parts)

    return run


def _as_runs(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*parts)]
    return pa.RecordBatch.from_arrays([_longs(cols[0]), _longs(cols[1]), *(pa.array(x) for x in cols[2:])], ["anchor", "content", "doc_id", "text_key", "first", "size"])


def _emit_windows(window: int):
    """The two hashes of each window of a document's owned runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text, asked in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text"), batch.column("asked").to_pylist()):
                hashes = word_hashes(_raw(text))
                at = np.concatenate([np.arange(x["first"], x["first"] + x["size"]) for x in sorted(asked, key=lambda x: x["first"])])
                for begin in range(int(at[0]), int(at[-1]) + 1, SEGMENT):
                    here = at[np.searchsorted(at, begin) : np.searchsorted(at, begin + SEGMENT)]
                    part, place = hashes[begin : begin + SEGMENT + window - 1], here - begin
                    one, two = Rolling(part, 2).runs(place, place + window), Rolling(part, 3).runs(place, place + window)
                    yield pa.RecordBatch.from_arrays([_longs(one), _longs(two), pa.array(np.full(len(here), doc, np.int64)), pa.array(np.full(len(here), key, np.int64)), pa.array(here.astype(np.int64))], ["one", "two", "doc_id", "text_key", "first"])

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals that cover the given ones; touching ones join."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.concatenate((new[1:], [True]))
    return list(zip(starts[new].tolist(), reach[last].tolist()))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed, digests, removed = [], [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                raw = _raw(text)
                start, end = word_bounds(raw)
                repeats = [(x["first"], x["first"] + x["size"] + window - 1) for x in spans or ()]
                gone = merged(*np.array(repeats).T) if repeats else []
                bounds = [0, *(x for pair in gone for x in pair), len(start)]
                pieces = []
                for a, b in zip(bounds[::2], bounds[1::2]):
                    if a < b:
                        pieces.append(b" ".join(raw[start[a] : end[b - 1]].split()))
                out = b" ".join(pieces)
                texts.append(out.decode("utf-8", "replace"))
                n_words.append(len(start))
                n_removed.append(sum(b - a for a, b in gone))
                digests.append(hashlib.sha256(out).hexdigest())
                removed.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "kept_text", "n_words", "n_removed", "kept_sha256", "removed"],
            )

    return run


def cut_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed, kept_sha256 and the removed word intervals, a row per row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    runs = stash(texts.mapInArrow(_emit_runs(window, anchor), _RUN_FIELDS), "runs")
    of_anchor = runs.groupBy("anchor").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.count("*").alias("n_rows"))
    shared = stash(of_anchor.where("lo <> hi OR d0 < d1").select("anchor", (F.col("lo") != F.col("hi")).alias("several"), "d0", "n_rows"), "anchors")
    known = stash(join_counted(runs, shared, ["anchor"]), "known")
    span = F.struct("first", "size")
    # An anchor with one content is owned by its smallest document.
    alone = known.where("NOT several AND doc_id > d0").select("doc_id", "text_key", span.alias("span"))
    several = known.where("several").drop("several", "d0")
    owners = stash(several.groupBy("anchor", "content").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n_rows")), "owners")
    owned = stash(join_counted(several, owners, ["anchor", "content"]).select("doc_id", "text_key", span.alias("span"), (F.col("doc_id") > F.col("owner")).alias("repeated")), "owned")
    repeated = alone.unionByName(owned.where("repeated").drop("repeated"))

    asked = owned.where("NOT repeated").groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("asked"))
    windows = stash(texts.join(asked, ["doc_id", "text_key"]).mapInArrow(_emit_windows(window), "one long, two long, doc_id long, text_key long, first long"), "windows")
    firsts = windows.groupBy("one", "two").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n_rows"))
    firsts = stash(firsts.where("owner < last").drop("last"), "firsts")
    single = join_counted(windows, firsts, ["one", "two"]).where("doc_id > owner").select("doc_id", "text_key", F.struct("first", F.lit(1).alias("size")).alias("span"))
    spans = repeated.unionByName(single).groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"))
    return texts.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(window), _OUT_FIELDS)
