"""A stored full-text index and ranked search over it (Q1).

Documents are numbered and dealt to ranges of consecutive numbers. Postings lie sorted by term and range, and for each block, a
term in a range, there is the most that any of its documents can add to a score; wide blocks have the same bound for many ranges.

A question with many postings scores a few documents that have its rarest words: the k-th score there is the bar. It adds up the
bounds of its terms, first over wide ranges and then over ranges; those below the bar are skipped. Of the others, the blocks of
the terms that a document must have to reach the bar are read (the most common terms together may not reach it), and those of the
other terms only for documents that, with the bounds of these terms in their range, can still do so. What is skipped can't be
among the k best: the ranks are those of a full scan.

As long as the questions together have a bounded number of words, their postings are dealt by document instead, and each task
adds them up for its own documents and all questions: what is shuffled grows with the postings, not with questions times documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import folder, written

#: BM25.
K1, B = 1.2, 0.75

#: Bits of a document's number below its range, and of a range's below its wide range.
RANGE, WIDE = 6, 6
#: Folders to which terms are dealt; documents with the rarest words of a question that are looked at first, about.
BUCKETS, LEAD = 32, 1_000
#: Postings of all questions up to which they are scored without bounds: the steps of pruning would take longer.
DIRECT = 100_000_000
#: Words of all questions up to which tasks have them all; postings dealt to a task, and sums and hits that it holds at once, about.
ASKED, POSTINGS, CELLS = 1 << 18, 2_000_000, 1 << 20


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\W+"), lambda t: t != "")


@dataclass(frozen=True)
class Index:
    """A stored index: its folder, the type of its documents' ids, their number and mean number of words, whether it has bounds."""

    path: str
    kind: str
    n: int
    mean: float
    bounds: bool = True

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        columns = {
            "postings": f"term string, range long, id {self.kind}, tf int, length int, lead boolean, bucket int", "blocks": "bucket int, term string, range long, most double, n long",
            "wide": "term string, wide long, most double", "terms": "term string, df long, most double",
        }
        return spark.read.schema(columns[name]).parquet(f"{self.path}/{name}")


def _part(mean: float) -> Column:
    """What a posting adds to a score, without the weight of its term."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))


def _bucket(term: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"), F.lit(-1))


def build_index(corpus: DataFrame, columns: Sequence[str] = ("content",), path: str | None = None, bounds: bool = True) -> Index:
    """Writes the index of the columns of corpus (id, columns), once for all later questions, to path or a new shared folder.

    Tables: postings (bucket, term, range, id, tf, length), blocks (bucket, term, range, most, n), wide (term, wide, most),
    terms (term, df, most), stats (kind, n, mean, bounds). Without bounds there are no blocks and wide, which only questions
    with more than ASKED words read; these are then scored without pruning. The texts are read, cut to words and shuffled once. A common term is dealt over
    many files by its wide ranges; who reads few terms opens the folders and row groups that have them.
    """
    spark, path = corpus.sparkSession, path or folder(corpus.sparkSession)
    rows = corpus.select("id", F.monotonically_increasing_id().alias("number"), F.sort_array(tokens(F.concat_ws(" ", *columns))).alias("tokens"))
    # words are counted within their row, as runs of the sorted list: only distinct ones are shuffled
    n, at = F.size("tokens"), lambda i: F.get(F.col("tokens"), i)
    runs = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i) != at(i - 1))))
    rows = rows.select("id", "number", "tokens", n.alias("length"), runs.alias("runs"))
    counted = F.transform("runs", lambda i, k: F.struct(at(i).alias("term"), (F.coalesce(F.get(F.col("runs"), k + 1), F.col("length")) - i).alias("tf")))
    said = rows.select("id", F.shiftright("number", RANGE).alias("range"), "length", F.posexplode_outer(counted).alias("pos", "w"))
    order = ["bucket", "term", "range"]
    lead = (F.col("pos").isNull() | (F.col("pos") == 0)).alias("lead")  # one row of each document
    said = said.select(_bucket(F.col("w.term")).alias("bucket"), F.col("w.term").alias("term"), "range", "id", F.coalesce("w.tf", F.lit(1)).alias("tf"), "length", lead)
    dealt = said.repartition("bucket", F.shiftright("range", WIDE))
    dealt.sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{path}/postings")
    kind = corpus.schema["id"].dataType.simpleString()
    index = Index(path, kind, 0, 1.0)
    stats = index.table(spark, "postings").where("lead").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
    index = Index(path, kind, stats["n"], stats["words"] / stats["n"] if stats["words"] else 1.0, bounds)
    spark.createDataFrame([(kind, index.n, float(index.mean), bounds)], "kind string, n long, mean double, bounds boolean").write.parquet(f"{path}/stats")
    postings = index.table(spark, "postings").where("bucket >= 0").withColumn("wide", F.shiftright("range", WIDE))
    if not bounds:
        postings.groupBy("term").agg(F.count("*").alias("df"), F.max(_part(index.mean)).alias("most")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
        return index
    blocks = postings.groupBy("bucket", "wide", "term", "range").agg(F.max(_part(index.mean)).alias("most"), F.count("*").alias("n"))
    blocks.select(*order, "most", "n").sortWithinPartitions(*order).write.parquet(f"{path}/blocks")
    known = index.table(spark, "blocks")
    known.groupBy("term", F.shiftright("range", WIDE).alias("wide")).agg(F.max("most").alias("most")).write.parquet(f"{path}/wide")
    known.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
    return index


def open_index(spark: SparkSession, path: str) -> Index:
    stats = spark.read.parquet(f"{path}/stats").first()
    return Index(path, stats["kind"], stats["n"], stats["mean"], stats["bounds"])


def _by_document(asked: DataFrame, postings: DataFrame, index: Index, k: int, slack: float) -> DataFrame:
    """query_id, id, score of the documents that can be among the k best of a question, a few from each task.

    A task adds up the postings of its documents for all questions, some documents at a time, and lets a document go if k others
    of the task are better by more than slack, or as good with smaller ids.
    """
    spark, known = asked.sparkSession, asked.select("query_id", "term", "idf", "df").collect()  # at most ASKED
    names, words = {}, {}
    for r in known:
        names.setdefault(r["query_id"], len(names))
        words.setdefault(r["term"], (len(words), r["df"]))
    pairs = sorted((words[r["term"]][0], names[r["query_id"]], r["idf"]) for r in known)
    first = np.searchsorted(np.array([t for t, _, _ in pairs]), np.arange(len(words) + 1))
    shared, mean = spark.sparkContext.broadcast((first, np.array([q for _, q, _ in pairs]), np.array([w for *_, w in pairs]))), index.mean
    some = max(1, CELLS // max(1, len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, asking, idf = shared.value
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = rows["id"].combine_chunks().dictionary_encode("encode")
        by_id = pc.sort_indices(pa.table({"id": ids.dictionary}), sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy()
        place = np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        doc, word = place[ids.indices.to_numpy()], rows["word"].to_numpy()
        order = np.lexsort((word, doc))  # sums of equal documents are equal
        doc, word, tf, length = doc[order], word[order], rows["tf"].to_numpy()[order], rows["length"].to_numpy()[order]
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        starts, hits = np.searchsorted(doc, np.arange(len(by_id) + 1)), np.concatenate([[0], np.cumsum(first[word + 1] - first[word])])
        bars, at = np.zeros(len(names)), 0
        while at < len(by_id):
            to = min(at + some, len(by_id), max(at + 1, int(np.searchsorted(hits[starts], hits[starts[at]] + CELLS, "right")) - 1))
            p = slice(starts[at], starts[to])
            n = first[word[p] + 1] - first[word[p]]
            of = np.repeat(np.arange(len(n)), n)
            pair = np.arange(len(of)) + np.repeat(first[word[p]] - (np.cumsum(n) - n), n)
            cell = asking[pair] * (to - at) + (doc[p] - at)[of]
            sums = np.bincount(cell, idf[pair] * part[p][of], len(names) * (to - at)).reshape(len(names), to - at)
            if to - at > k:
                bars = np.maximum(bars, np.partition(sums, to - at - k, axis=1)[:, to - at - k] - slack)
            q, d = np.nonzero((sums > 0) & (sums >= bars[:, None]))
            s = sums[q, d]
            best = np.lexsort((d, -s, q))
            q, d, s = q[best], d[best], s[best]
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1])
            good = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0)) < k
            q, d, s = q[good], d[good], s[good]
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), ids.dictionary.take(pa.array(by_id[d + at])), pa.array(s)], ["_q", "id", "score"])
            at = to

    numbered = spark.createDataFrame([(t, n) for t, (n, _) in words.items()], "term string, word int")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(df for _, df in words.values()) // POSTINGS))
    met = postings.join(F.broadcast(numbered), "term").select("id", "word", "tf", "length").repartition(tasks, "id")
    found = met.mapInArrow(run, f"_q int, id {index.kind}, score double")
    whose = spark.createDataFrame([(n, q) for q, n in names.items()], f"_q int, query_id {asked.schema['query_id'].dataType.simpleString()}")
    return found.join(F.broadcast(whose), "_q").select("query_id", "id", "score")


def search(queries: DataFrame, index: Index, k: int = 10, column: str = "text", digits: int | None = None, report: bool = False):
    """query_id, id, score, rank: the k best by BM25 for each question; each distinct word of a question counts once, digits
    rounds scores before they are ranked, and ties go to the smaller id. With report also query_id, blocks, read: the
    blocks of a question's terms and how many of them had to be read, with pruning even for few postings.

    A null question, or one without known words, has no rows. Nothing is broadcast but what Spark knows to be small from the
    sizes of written tables. A question whose rarest words are in fewer than k documents reads all its blocks.
    """
    spark = queries.sparkSession
    said = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(column)))).alias("term")).distinct()
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = said.join(index.table(spark, "terms"), "term").withColumn("idf", idf)
    asked = written(asked.select("query_id", "term", "idf", "df", (F.col("idf") * F.col("most")).alias("top")))
    hits, buckets, n = asked.agg(F.coalesce(F.sum("df"), F.lit(0)), F.collect_set(_bucket(F.col("term"))), F.count("*")).first()  # at most BUCKETS
    postings = index.table(spark, "postings").where(F.col("bucket").isin(buckets)).select("term", "range", "id", "tf", "length")
    rounded = lambda df: df if digits is None else df.withColumn("score", F.round("score", digits))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))

    def ranked(scores: DataFrame) -> DataFrame:
        return rounded(scores).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")

    if n <= ASKED and not report and "<" not in index.kind:
        return ranked(_by_document(asked, postings, index, k, 0.0 if digits is None else 10.0**-digits))
    score = F.sum(F.col("idf") * _part(index.mean)).alias("score")
    if (hits <= DIRECT or not index.bounds) and not report:
        return ranked(asked.select("query_id", "term", "idf").join(postings, "term").groupBy("query_id", "id").agg(score))

    def scored(terms: DataFrame, ranges: DataFrame | None, *carried: str, within: DataFrame | None = None) -> DataFrame:
        """query_id, range, id and the score by the given terms, of the documents of ranges (None: of all)."""
        met = terms.select("query_id", "term", "idf")
        met = met.join(ranges, "query_id").join(postings, ["term", "range"]) if ranges else met.join(postings, "term")
        met = met if within is None else met.join(within, ["query_id", "range", "id"], "left_semi")
        return met.groupBy("query_id", "range", "id").agg(score, *[F.first(c).alias(c) for c in carried])

    blocks = index.table(spark, "blocks").where(F.col("bucket").isin(buckets)).select("term", "range", "most", F.shiftright("range", WIDE).alias("wide"))
    most = F.col("idf") * F.col("most")
    wides = written(asked.drop("top").join(index.table(spark, "wide"), "term").groupBy("query_id", "wide").agg(F.sum(most).alias("bound")))

    def bounds(chosen: DataFrame, terms: DataFrame) -> DataFrame:
        """query_id, range, bound of all terms, rest: of those that are no must, and the numbers of blocks; within wide ranges."""
        met = terms.select("query_id", "term", "idf", "must").join(chosen.select("query_id", "wide"), "query_id").join(blocks, ["term", "wide"])
        rest = F.coalesce(F.sum(F.when(~F.col("must"), most)), F.lit(0.0))
        return met.groupBy("query_id", "range").agg(F.sum(most).alias("bound"), rest.alias("rest"), F.count("*").alias("blocks"), F.count_if("must").alias("musts"))

    rarest = F.sum("df").over(Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0))
    lead = asked.withColumn("_to", rarest).where((F.col("_to") <= LEAD) | (F.col("_to") == F.col("df")))
    some = written(scored(lead, None).withColumn("_r", place).where(F.col("_r") <= 2 * k).select("query_id", "range", "id"))
    first = scored(asked, some.select("query_id", "range").distinct(), within=some)
    kth = written(first.withColumn("_r", place).where(F.col("_r") == k).select("query_id", F.col("score").alias("kth")))
    # rounding may lift a score to the bar
    slack, bar = 0.0 if digits is None else 10.0**-digits, F.coalesce("kth", F.lit(0.0))
    reach = lambda df: df.join(kth, "query_id", "left").where(F.col("bound") * (1 + 1e-9) + slack >= bar)
    # terms whose bounds, from the smallest up, don't reach the bar together: no document has only these
    upto = F.sum("top").over(Window.partitionBy("query_id").orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0))
    asked = written(asked.join(kth, "query_id", "left").select("query_id", "term", "idf", (upto * (1 + 1e-9) + slack >= bar).alias("must")))
    alive = written(reach(bounds(reach(wides), asked)))
    part = scored(asked.where("must"), alive.select("query_id", "range", "rest", "kth"), "rest", "kth")
    part = written(part.where((F.col("score") + F.col("rest")) * (1 + 1e-9) + slack >= bar).select("query_id", "range", "id", "score"))
    kept = part.select("query_id", "range").distinct()
    more = scored(asked.where("not must"), kept, within=part.select("query_id", "range", "id"))
    found = ranked(part.unionByName(more).groupBy("query_id", "range", "id").agg(F.sum("score").alias("score")))
    if not report:
        return found
    every = bounds(wides, asked)
    read = alive.select("query_id", F.col("musts").alias("n")).union(alive.join(kept, ["query_id", "range"], "left_semi").select("query_id", F.col("blocks") - F.col("musts")))
    return found, every.groupBy("query_id").agg(F.sum("blocks").alias("blocks")).join(read.groupBy("query_id").agg(F.sum("n").alias("read")), "query_id")
