"""A stored full-text index: postings on disk, changed by deltas that are merged later.

An index is a folder of generations. Each holds documents (target, kind, title,
text, updated, len) and postings (term, target, title, body: positions). A
generation is written under a name of its own and renamed when it is whole, so a
reader sees all of it or nothing. The newest base and the deltas after it are the
index: a document put or deleted in a delta hides every earlier one.

Postings lie in BUCKETS partitions by the hash of the first PREFIX letters of
their term, sorted by term, so a word or a prefix of PREFIX letters and more
reads one partition, and of it the row groups that may hold it. Words of fewer
letters are their own prefix.

Ranking is BM25 over title and body with weights; documents without a word are not
counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomespark.operators.search import B, BODY_WEIGHT, K1, KIND_GROUPS, TITLE_WEIGHT, Term, parse_query, tokens

BUCKETS, PREFIX = 64, 3
#: Positions that a task holds as Python values.
PLACES = 100_000
#: Goes up when what lies on disk changes its form.
LAYOUT = 2
DOCUMENTS = "target string, kind string, title string, text string, updated long, len long, deleted boolean"
POSTINGS = "term string, target string, title array<int>, body array<int>, bucket int"


def bucket(term: Column) -> Column:
    """The partition of a term; of a literal it is folded to a constant, which prunes."""
    return F.pmod(F.xxhash64(F.substring(term, 1, PREFIX)), F.lit(BUCKETS)).cast("int")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The positions of each token of a document, gathered where the document lies.

    One document at a time becomes Python values, and rows go on in batches of
    about PLACES positions, so memory depends on neither the documents of a task
    nor those of a batch.
    """
    lists = pa.list_(pa.int32())

    def rows(terms: list, targets: list, title: list, body: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(targets, pa.string()), pa.array(title, lists), pa.array(body, lists)], names=["term", "target", "title", "body"])

    held: tuple[list, list, list, list] = [], [], [], []
    n = 0
    for batch in batches:
        for row in range(batch.num_rows):
            target, *columns = (c[row].as_py() for c in batch.columns)
            places: dict[str, tuple[list[int], list[int]]] = {}
            for k, found in enumerate(columns):
                for i, term in enumerate(found):
                    if term not in places:
                        places[term] = ([], [])
                    places[term][k].append(i)
                n += len(found)
            for column, values in zip(held, (places, [target] * len(places), [t for t, _ in places.values()], [b for _, b in places.values()])):
                column += values
            if n >= PLACES:
                yield rows(*held)
                held, n = ([], [], [], []), 0
    if n:
        yield rows(*held)


def term_postings(docs: DataFrame) -> DataFrame:
    """(term, target, title, body, bucket): the sorted positions of each term in both columns of each document."""
    split = docs.select("target", tokens(F.col("title")).alias("title"), tokens(F.col("text")).alias("body"))
    found = split.mapInArrow(_placed, "term string, target string, title array<int>, body array<int>")
    return found.withColumn("bucket", bucket(F.col("term")))


class Index:
    """The index in the folder ``root``, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # Generations

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        """Generations in order: eight digits and ``base`` or ``delta``; what is being written has another name."""
        path, fs = self._path("")
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in found if n.endswith((".base", ".delta")))

    def generations(self) -> tuple[str | None, list[str]]:
        """The newest base, and the deltas after it."""
        names = self._names()
        bases = [n for n in names if n.endswith(".base")]
        base = bases[-1] if bases else None
        return base, [n for n in names if n.endswith(".delta") and (base is None or n > base)]

    def _write(self, kind: str, documents: DataFrame, postings: DataFrame | None) -> None:
        names = self._names()
        name = f"{int(names[-1][:8]) + 1 if names else 1:08d}"
        at = f"{self.root}/{name}.writing"
        documents.write.mode("overwrite").parquet(f"{at}/documents")
        if postings is not None:
            # A partition that many postings fall into is split by adaptive execution, so no term is bound to one task.
            rows = postings.hint("rebalance", "bucket")
            rows.sortWithinPartitions("bucket", "term", "target").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings")
        (source, fs), (to, _) = self._path(f"{name}.writing"), self._path(f"{name}.{kind}")
        if not fs.rename(source, to):
            raise RuntimeError(f"another writer made generation {name}")

    @staticmethod
    def _rows(docs: DataFrame, deleted: bool = False) -> DataFrame:
        size = F.size(tokens(F.col("title"))) + F.size(tokens(F.col("text")))
        return docs.select("target", "kind", "title", "text", F.col("updated").cast("long").alias("updated"), size.cast("long").alias("len"), F.lit(deleted).alias("deleted"))

    def _dealt(self, docs: DataFrame) -> DataFrame:
        """Documents in as many parts as there are cores at least: a single file would be read by one of them."""
        cores = self.spark.sparkContext.defaultParallelism
        few = docs.select("target", "kind", "title", "text", "updated")
        return few.repartition(cores) if docs.rdd.getNumPartitions() < cores else few

    def build(self, docs: DataFrame) -> Index:
        """A new base of ``docs`` (target, kind, title, text, updated), which have a row per target."""
        docs = self._dealt(docs)
        self._write("base", self._rows(docs), term_postings(docs))
        return self

    def complete(self) -> bool:
        """Whether the index was finished by done()."""
        path, fs = self._path("done")
        return fs.exists(path)

    def done(self) -> None:
        """Note that all that belongs into the index is in it."""
        path, fs = self._path("done")
        fs.create(path, True).close()

    def put(self, docs: DataFrame) -> None:
        """Add documents, or replace those with their targets."""
        self._write("delta", self._rows(docs), term_postings(docs))

    def delete(self, targets: DataFrame) -> None:
        """Take documents out. ``targets`` has a column ``target``."""
        nothing = {c: F.lit(None).cast("string") for c in ("kind", "title", "text")}
        gone = targets.select("target").distinct().withColumns(nothing).withColumns({"updated": F.lit(None).cast("long"), "len": F.lit(0).cast("long"), "deleted": F.lit(True)})
        self._write("delta", gone, None)

    def delete_prefix(self, prefix: str) -> None:
        self.delete(self.documents().where(F.startswith("target", F.lit(prefix))))

    def clear(self) -> None:
        """An empty base."""
        self._write("base", self.spark.createDataFrame([], DOCUMENTS), self.spark.createDataFrame([], POSTINGS))

    def merge(self) -> None:
        """Base and deltas in one new base; readers of the old one go on until drop_old()."""
        self._write("base", self.documents(), self.postings())

    def drop_old(self) -> None:
        """Delete the generations that the newest base holds."""
        base, _ = self.generations()
        for name in self._names():
            if base is not None and name < base:
                path, fs = self._path(name)
                fs.delete(path, True)

    # Reading

    def _documents(self, name: str) -> DataFrame:
        return self.spark.read.schema(DOCUMENTS).parquet(f"{self.root}/{name}/documents")

    def _postings(self, name: str) -> DataFrame | None:
        path, fs = self._path(f"{name}/postings")
        return self.spark.read.schema(POSTINGS).parquet(path.toString()) if fs.exists(path) else None

    def _changes(self, deltas: list[str]) -> DataFrame | None:
        """(target, seq): the last delta that each changed target is in. Deltas are small until they are merged."""
        out = None
        for name in deltas:
            rows = self._documents(name).select("target", F.lit(int(name[:8])).alias("seq"))
            out = rows if out is None else out.unionByName(rows)
        return None if out is None else out.groupBy("target").agg(F.max("seq").alias("seq"))

    def _alive(self, read) -> DataFrame | None:
        """What ``read`` gives of every generation, without what a later one hides."""
        base, deltas = self.generations()
        changes = self._changes(deltas)
        out = None if base is None else read(base)
        if out is not None and changes is not None:
            out = out.join(changes, "target", "left_anti")
        for name in deltas:
            rows = read(name)
            if rows is not None:
                rows = rows.join(changes.where(F.col("seq") == int(name[:8])), "target", "left_semi")
                out = rows if out is None else out.unionByName(rows)
        return out

    def documents(self) -> DataFrame:
        out = self._alive(self._documents)
        return self.spark.createDataFrame([], DOCUMENTS) if out is None else out.where(~F.col("deleted"))

    def postings(self, where: Column | None = None) -> DataFrame:
        """The postings, of which only what ``where`` needs is read."""

        def read(name: str) -> DataFrame | None:
            rows = self._postings(name)
            return rows if rows is None or where is None else rows.where(where)

        out = self._alive(read)
        return self.spark.createDataFrame([], POSTINGS) if out is None else out

    def count(self, prefix: str = "") -> int:
        """How many documents have a target that starts with ``prefix``."""
        return self.documents().where(F.startswith("target", F.lit(prefix))).count()

    def document_frequency(self, words: list[str]) -> DataFrame:
        """(term, df) of the given words, which the caller asks for by name."""
        return self.postings(_held([Term((w,), False) for w in words])).groupBy("term").agg(F.count("*").alias("df"))

    def search(self, q: str, kind: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """(target, kind, title, score), best first."""
        terms = parse_query(q)
        documents = self.documents().select("target", "kind", "title", "updated", "len")
        if not terms:
            return documents.select("target", "kind", "title", F.lit(0.0).alias("score")).limit(0)
        counted = self.postings(_held(terms)).groupBy("target").agg(*(_frequency(t).alias(f"tf{k}") for k, t in enumerate(terms)))
        frequencies = counted.agg(*(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))))
        corpus = documents.where("len > 0").agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
        held = counted
        for k in range(len(terms)):
            held = held.where(F.col(f"tf{k}") > 0)
        known = held.join(documents, "target").crossJoin(F.broadcast(frequencies)).crossJoin(F.broadcast(corpus))  # one row each
        score = F.lit(0.0)
        for k in range(len(terms)):
            tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
            idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
        out = known.withColumn("score", score)
        if kind:
            out = out.where(F.col("kind").isin(KIND_GROUPS[kind]))
        out = out.orderBy(F.desc("score"), F.desc("updated"), "target").select("target", "kind", "title", "score")
        if offset:
            out = out.offset(offset)
        return out.limit(limit) if limit else out


def _held(terms: list[Term]) -> Column:
    """Which postings the words of a query need: their partitions, and in these their terms."""
    out = F.lit(False)
    for term in terms:
        for k, word in enumerate(term.words):
            is_it = F.startswith("term", F.lit(word)) if term.prefix and k == 0 else F.col("term") == word
            out = out | ((F.col("bucket") == bucket(F.lit(word))) & is_it)
    return out


def _frequency(term: Term) -> Column:
    """How often a document holds a term, by weight; of a phrase, where its words follow each other."""
    weighted = lambda title, body: TITLE_WEIGHT * F.size(title) + BODY_WEIGHT * F.size(body)
    if len(term.words) == 1:
        is_it = F.startswith("term", F.lit(term.words[0])) if term.prefix else F.col("term") == term.words[0]
        return F.coalesce(F.sum(F.when(is_it, weighted(F.col("title"), F.col("body")))), F.lit(0.0))

    def starts(column: str) -> Column:
        """Where the phrase starts: the places of its words, each moved back by its own place, have these in common."""
        moved = lambda k, word: F.transform(F.coalesce(F.max(F.when(F.col("term") == word, F.col(column))), F.array().cast("array<int>")), lambda p: p - k)
        out = moved(0, term.words[0])
        for k, word in enumerate(term.words[1:], 1):
            out = F.array_intersect(out, moved(k, word))
        return out

    return weighted(starts("title"), starts("body"))
