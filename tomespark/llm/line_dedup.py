"""Line dedup: lines found in many documents leave every document.

Every text is cut at newlines and each line is reduced to a key (stripped of
blanks, A-Z lower-cased). A document states each of its keys once, as a 128-bit
hash; Spark counts documents per hash with map-side combination, keeps the
hashes over the threshold, and hands every document the set of those that it
holds. A line that a great part of all documents hold is joined by broadcast, so
its documents are no task of their own. The texts are shuffled once, by document,
and lose their marked lines in place, so positions need no sort.

Defined cases: a null or empty text is one empty line, which has an empty key
and stays. Very long texts are read whole. With ``by_id``, as the queries call
it, rows of one ``doc_id`` are one document, and rows with a null one are not
counted but lose frequent lines too. Without it each row counts as one document.
Repeated rows are cut alike. A line in exactly the least number of documents (a
tie) goes. An empty table gives no rows. Other columns are not read, whatever
their names; ``with_kept_lines`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomespark.llm.common import BLANKS, join_counted, row_key, stash

MIN_DOCUMENTS = 10
MIN_KEY_CHARS = 1


def line_key(line: str) -> bytes:
    """The line without outer blanks and with A-Z lower-cased, in UTF-8."""
    return line.strip(BLANKS).encode("utf-8", "surrogatepass").lower()


def hashed(key: bytes) -> tuple[int, int]:
    """128 bits of a key as two signed 64-bit integers."""
    raw = xxhash.xxh3_128_digest(key)
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _state_keys(least: int):
    """For every document its row key, its id and the hash of each of its distinct line keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, his, los = [], [], [], []
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                keys = {line_key(x) for x in (text.as_py() or "").split("\n")}
                for hi, lo in {hashed(k) for k in keys if k and (len(k) >= 4 * least or len(k.decode("utf-8", "surrogatepass")) >= least)}:
                    rows.append(row), ids.append(doc), his.append(hi), los.append(lo)
            yield pa.RecordBatch.from_arrays([pa.array(rows, batch.schema.field(0).type), *(pa.array(x, pa.int64()) for x in (ids, his, los))], ["row_key", "doc_id", "hi", "lo"])

    return run


def _drop_marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The document with its marked lines taken out, and how many those were."""
    for batch in batches:
        kept, n_lines, n_dropped, digests = [], [], [], []
        for text, marked in zip(batch.column("text"), batch.column("marked").to_pylist()):
            lines = (text.as_py() or "").split("\n")
            stay = lines
            if marked:
                gone = {(x["hi"], x["lo"]) for x in marked}
                stay = [x for x in lines if not (k := line_key(x)) or hashed(k) not in gone]
            out = "\n".join(stay)
            kept.append(out)
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            digests.append(hashlib.sha256(out.encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "kept_text", "n_lines", "n_dropped", "kept_sha256"],
        )


def _marked(docs: DataFrame, min_documents: int, min_key_chars: int, by_id: bool) -> DataFrame:
    """(row_key, marked): the hashes of the frequent lines of each document that has some."""
    named = docs.select(row_key("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stated = stash(named.mapInArrow(_state_keys(min_key_chars), "row_key struct<a:long,b:long>, doc_id long, hi long, lo long"), "lines")
    counts = F.count("*").alias("n_rows")
    if by_id:
        each = stated.groupBy("hi", "lo", "doc_id").agg(counts)
        found = each.groupBy("hi", "lo").agg(F.count("doc_id").alias("n"), F.sum("n_rows").alias("n_rows"))
    else:
        found = stated.groupBy("hi", "lo").agg(F.count("*").alias("n"), counts)
    frequent = stash(found.where(F.col("n") >= min_documents).drop("n"), "frequent")
    return join_counted(stated, frequent, ["hi", "lo"]).groupBy("row_key").agg(F.collect_set(F.struct("hi", "lo")).alias("marked"))


def drop_repeated_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_key_chars: int = MIN_KEY_CHARS, by_id: bool = False) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped, kept_sha256, one row per row of ``docs``."""
    # A document is known by doc_id and the hash of its text: equal rows are marked alike.
    named = docs.select(row_key("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = _marked(docs, min_documents, min_key_chars, by_id)
    return named.join(marked, "row_key", "left").select("doc_id", "text", "marked").mapInArrow(_drop_marked, "doc_id long, kept_text string, n_lines long, n_dropped long, kept_sha256 string")


def with_kept_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_key_chars: int = MIN_KEY_CHARS, by_id: bool = False) -> DataFrame:
    """``docs`` with ``text`` replaced by what is kept of it; all other columns as they are."""
    rest = [c for c in docs.columns if c != "text"]
    marked = _marked(docs, min_documents, min_key_chars, by_id)
    held = docs.select(row_key("doc_id", "text").alias("row_key"), F.struct(*rest).alias("rest"), F.col("text").cast("string").alias("text"))
    joined = held.join(marked, "row_key", "left").select("rest", "text", "marked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text"), batch.column("marked")], ["doc_id", "text", "marked"])
            for cut in _drop_marked(iter((plain,))):
                yield pa.RecordBatch.from_arrays([batch.column("rest"), cut.column("kept_text")], ["rest", "text"])

    out = joined.mapInArrow(run, joined.drop("marked").schema)
    return out.select(*(F.col(f"rest.`{c}`").alias(c) if c != "text" else F.col("text") for c in docs.columns))
