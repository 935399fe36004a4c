"""A stored inverted index: extended by commits, ranked by BM25 with skipped blocks.

Four Parquet tables under one folder, each with a folder a batch:

* ``postings/batch=N/bucket=B``: a row a block, ``(term, chunk, n, max_tf, min_dl,
  entries)``; ``entries`` holds ``(doc, tf, dl)``.  The documents of a batch are
  dealt to chunks of about ``CHUNK`` by a hash of their keys, a term's postings in a
  chunk to levels of their saturated frequency.  So a block has a bounded size,
  however frequent the term is, and postings of much weight lie together;
* ``docs/batch=N``: ``(doc, dl, chunk)``;
* ``dead/batch=N``: versions of documents that the batch replaces or deletes;
* ``stats/batch=N``: one row of counts.

A batch is written to folders of its own from its rows and the batches before it, so
writing it again gives the same index.  Batches are written in ascending order, one
at a time.  ``topk`` reads the buckets of its terms only.

Defined results: rows of a null key are left out.  A null text has no words, but
counts as a document of length 0.  Of rows of one key in a batch the greatest text
stands; a key met again in a later batch replaces the former version.  A batch
without rows adds nothing.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.sources.session import ship, stored

from .search import K1, B, tokenise

#: Documents a chunk, buckets of terms, levels of weight.
CHUNK, BUCKETS, LEVELS = 8192, 64, 8
#: Length that the levels (not the scores) take for the mean.
USUAL = 256
#: Of a search of many queries: queries and documents of a task, and queries and terms
#: that are multiplied at once.
QUERIES, DOCUMENTS, STRIP, WIDE = 4096, 8192, 512, 1024
#: Documents of a term that brings them to its queries by a join.
RARE = 16
#: Blocks a term that give the first bound of the k-th score.
FIRST = 4


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def weight(tf: Column, dl: Column, mean: Column | float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def idf(n: float, df: float) -> Column:
    return F.log(1 + (F.lit(float(n)) - df + 0.5) / (F.lit(float(df)) + 0.5))


def occurrences(docs: DataFrame, key: str = "id", text: str = "text", chunk_docs: int = CHUNK) -> DataFrame:
    """``(doc, words, chunk)``, once a key; chunks are partitioned together, so what
    follows groups by chunk without another shuffle."""
    rows, chunks, once = _rows(docs, key, text, chunk_docs)
    # a chunk or a few are a task: what is made of their words there stays in memory
    dealt = rows.repartition(4 * chunks, "chunk")
    if not once:
        dealt = dealt.groupBy("chunk", "doc").agg(F.max("text").alias("text"))
    return dealt.select("doc", _words(), "chunk")


def _words() -> Column:
    return F.coalesce(tokenise(F.col("text")), F.array().cast("array<string>")).alias("words")


def _rows(docs: DataFrame, key: str, text: str, chunk_docs: int = CHUNK) -> tuple[DataFrame, int, bool]:
    """``(doc, text, chunk)``, the number of chunks, and whether every key comes once."""
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter("doc is not null")
    n, keys = rows.agg(F.count(F.lit(1)), F.count_distinct("doc")).first()
    chunks = max(1, -(-n // chunk_docs))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc"), F.lit(chunks)).cast("int")), chunks, n == keys


def blocks(words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The postings of ``occurrences`` in blocks."""
    each = words.select("chunk", "doc", F.size("words").alias("dl"), F.explode("words").alias("term"))
    tf = each.groupBy("chunk", "doc", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    level = F.floor(weight(F.col("tf"), F.col("dl"), float(USUAL)) / (K1 + 1) * LEVELS).cast("int")
    held = tf.groupBy("chunk", "term", level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.sort_array(F.collect_list(F.struct("doc", "tf", "dl"))).alias("e")
    )
    # numbers of a kind side by side take a third of the bytes of structs in a shuffle; one bucket's
    # blocks stay together as far as partitions of the usual size allow
    flat = held.select("term", "chunk", "n", "max_tf", "min_dl", *[F.col(f"e.{c}").alias(c) for c in ("doc", "tf", "dl")], bucket(F.col("term"), buckets).alias("bucket")).hint("rebalance", "bucket")
    entries = F.transform(F.arrays_zip("doc", "tf", "dl"), lambda x: F.struct(x["doc"].alias("doc"), x["tf"].alias("tf"), x["dl"].alias("dl")))
    return flat.select("term", "chunk", "n", "max_tf", "min_dl", entries.alias("entries"), "bucket")


def _table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder yet, or no file with rows
            return None
        raise


def _before(df: DataFrame | None, batch: int) -> DataFrame | None:
    return None if df is None else df.filter(F.col("batch") < batch)


def live_docs(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """``(doc, batch, dl, chunk)`` of the versions that stand (before a batch)."""
    docs, dead = _table(spark, path, "docs"), _table(spark, path, "dead")
    if before is not None:
        docs, dead = _before(docs, before), _before(dead, before)
    if docs is None or dead is None:
        return docs
    return docs.join(dead.select("doc", F.col("of").alias("batch")), ["doc", "batch"], "left_anti")


def extend(docs: DataFrame, path: str, batch: int, key: str = "id", text: str = "text", deleted: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Write a batch: its documents, and the versions that these and the keys of
    ``deleted`` (a column ``doc``) replace."""
    spark = docs.sparkSession
    words = occurrences(docs, key, text)
    held = blocks(words, buckets).sortWithinPartitions("bucket", "term")
    held.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    rows, _, once = _rows(docs, key, text)
    if once:  # texts need not meet to be counted
        words = rows.select("doc", _words(), "chunk")
    words.select("doc", F.size("words").alias("dl"), "chunk").write.mode("overwrite").parquet(f"{path}/docs/batch={batch}")
    now = spark.read.parquet(f"{path}/docs/batch={batch}")
    earlier = live_docs(spark, path, batch)
    gone = now.select("doc") if deleted is None else now.select("doc").union(deleted.select(F.col("doc").cast(now.schema["doc"].dataType)))
    if earlier is None:
        dead = now.limit(0).select("doc", F.lit(0).alias("of"), "chunk", "dl")
    else:
        dead = earlier.join(gone.distinct(), "doc", "left_semi").select("doc", F.col("batch").cast("int").alias("of"), "chunk", "dl")
    dead.write.mode("overwrite").parquet(f"{path}/dead/batch={batch}")
    sums = lambda df, n, dl: df.agg(F.count(F.lit(1)).alias(n), F.coalesce(F.sum(F.col("dl").cast("long")), F.lit(0)).cast("long").alias(dl))
    counts = sums(now, "docs", "words").crossJoin(sums(spark.read.parquet(f"{path}/dead/batch={batch}"), "dead", "dead_words"))  # one row each
    counts.write.mode("overwrite").parquet(f"{path}/stats/batch={batch}")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """``(term, doc, tf, dl)`` of all documents that stand."""
    held = _table(spark, path, "postings")
    if held is None:
        return _table(spark, path, "docs").select(F.lit("").alias("term"), "doc", F.lit(0).alias("tf"), "dl").limit(0)
    # whole batches stand, but for the few versions that later ones replace: a table of all documents would bring all postings to a shuffle
    held = held.join(F.broadcast(_table(spark, path, "docs").select("batch").distinct()), "batch", "left_semi")
    rows = held.select("term", "batch", F.explode("entries").alias("e")).select("term", "batch", "e.*")
    dead = _table(spark, path, "dead")
    if dead is not None and not dead.isEmpty():
        rows = rows.join(dead.select("doc", F.col("of").alias("batch")), ["doc", "batch"], "left_anti")
    return rows.select("term", "doc", "tf", "dl")


class Index:
    """An index opened for searching, as it stands now."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        total = _table(spark, path, "stats").agg(*[F.sum(c).alias(c) for c in ("docs", "words", "dead", "dead_words")]).first()
        self.docs, self.words = total["docs"] - total["dead"], total["words"] - total["dead_words"]
        self.mean = self.words / self.docs if self.words else 1.0
        self.postings = _table(spark, path, "postings")
        self.dead = _table(spark, path, "dead").select("doc", F.col("of").alias("batch"), "chunk") if total["dead"] else None

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The blocks of the terms, from their buckets alone."""
        at = [bucket(F.lit(t), self.buckets) for t in terms]  # literals once the plan is optimised
        return self.postings.filter(F.col("bucket").isin(*at) & F.col("term").isin(terms))

    def standing(self, rows: DataFrame) -> DataFrame:
        """Rows ``(doc, batch, ...)`` of the versions that stand."""
        return rows if self.dead is None else rows.join(self.dead.select("doc", "batch"), ["doc", "batch"], "left_anti")

    def topk(self, terms: list[str], k: int = 20) -> DataFrame:
        """``(doc, score)``: the k best by BM25, equal scores in the order of keys.

        A first bound of the k-th score comes from the heaviest blocks.  A block is
        skipped if its own greatest weight and those of all other terms cannot reach
        the bound: none of its documents is among the k best.  Scores and counts are
        of the documents that stand alone."""
        held, kept, scored = self._blocks(sorted(set(terms)), k)
        if kept is None:
            return _table(self.spark, self.path, "docs").select("doc", F.lit(0.0).alias("score")).limit(0)
        return scored(kept).orderBy(F.desc("score"), "doc").limit(k)

    def _blocks(self, terms: list[str], k: int):
        """All blocks of the terms, those not skipped, and what scores blocks."""
        if not terms or self.postings is None or not self.words:
            return None, None, None
        held = self.of_terms(terms)
        # a row a term; blocks that may hold dead versions are the only ones opened
        heads = held.select("term", "n", weight(F.col("max_tf"), F.col("min_dl"), self.mean).alias("most"))
        counts = heads.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
        if self.dead is not None:
            opened = held.join(self.dead.select("batch", "chunk").distinct(), ["batch", "chunk"], "left_semi").select("term", "batch", F.explode("entries.doc").alias("doc"))
            lost = opened.join(self.dead.select("doc", "batch"), ["doc", "batch"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("lost"))
            counts = counts.join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"), "most")
        found = {r["term"]: (r["df"], r["most"]) for r in counts.collect() if r["df"]}
        if not found:
            return held, None, None
        per_term = lambda f: F.coalesce(*[F.when(F.col("term") == t, f(t)) for t in found], F.lit(0.0))
        weights = {t: idf(self.docs, df) for t, (df, _) in found.items()}
        bound = per_term(lambda t: weights[t] * weight(F.col("max_tf"), F.col("min_dl"), self.mean))
        rest = per_term(lambda t: sum((weights[o] * F.lit(most) for o, (_, most) in found.items() if o != t), F.lit(0.0)))
        held = held.filter(F.col("term").isin(list(found))).withColumn("bound", bound).withColumn("rest", rest)

        def scored(some: DataFrame) -> DataFrame:
            rows = self.standing(some.select("term", "batch", F.explode("entries").alias("e")).select("term", "batch", "e.*"))
            one = per_term(lambda t: weights[t] * weight(F.col("tf"), F.col("dl"), self.mean))
            return rows.groupBy("doc").agg(F.round(F.sum(one), 6).alias("score"))

        # the heaviest blocks, whichever term they are of: a bounded number
        first = held.orderBy(F.desc("bound")).limit(FIRST * len(found) * max(1, k // 8))
        least = scored(first).orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
        least = least["s"] if least["n"] >= k else 0.0
        return held, held.filter(F.col("bound") + F.col("rest") >= least - 1e-5), scored

    def _gains(self, terms: DataFrame) -> DataFrame:
        """``(term, doc, gain, df)``: what each of the terms adds to a document's score, and its documents."""
        rows = self.postings.join(terms.select("term").distinct(), "term", "left_semi").select("term", "batch", F.explode("entries").alias("e")).select("term", "batch", "e.*")
        rows = self.standing(rows)
        df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        n = float(self.docs)
        gain = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * weight(F.col("tf"), F.col("dl"), self.mean)
        return rows.join(df, "term").select("term", "doc", gain.alias("gain"), "df")

    def scores(self, queries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """``(q, doc, score)`` for many queries ``(q, term)`` at once: every document
        that holds a term of a query, or those of ``pairs`` ``(q, doc)`` alone."""
        wanted, on = queries.select("q", "term").distinct(), ["term"]
        if pairs is not None:
            wanted, on = pairs.select("q", "doc").distinct().join(wanted, "q"), ["term", "doc"]
        return self._gains(queries).join(wanted, on).groupBy("q", "doc").agg(F.round(F.sum("gain"), 6).alias("score"))

    def best(self, queries: DataFrame, k: int) -> DataFrame:
        """``(q, doc, score)``: the k best of ``scores``, equal ones in the order of keys,
        without a row for every query and document that share a word.

        Terms of few documents bring queries and documents together by a join, and these pairs get
        their whole score.  By the other terms, documents of equal gains are one class and queries of
        equal terms another; blocks of these meet in tasks, which keep k a query.  The k best documents
        lie in the k best classes, each of which has its k first."""
        wanted = stored(queries.select("q", "term").distinct())
        gains = stored(self._gains(wanted))
        pairs = stored(wanted.join(gains.filter(F.col("df") <= RARE), "term").select("q", "doc").distinct())
        some = gains.join(pairs.select("doc").distinct(), "doc", "left_semi")
        near = pairs.join(wanted, "q").join(some, ["term", "doc"]).groupBy("q", "doc").agg(F.round(F.sum("gain"), 6).alias("score"))
        often = gains.filter(F.col("df") > RARE)
        alike = Window.partitionBy("held")
        docs = often.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("term", "gain"))).alias("held"))
        docs = docs.withColumn("_rank", F.row_number().over(alike.orderBy("doc"))).filter(F.col("_rank") <= k)
        docs = stored(docs.withColumn("class", F.min("doc").over(alike)))
        asked = wanted.join(often.select("term").distinct(), "term", "left_semi").groupBy("q").agg(F.sort_array(F.collect_list("term")).alias("held"))
        asked = stored(asked.withColumn("of", F.min("q").over(alike)))
        rows = docs.filter("_rank = 1").select("class", F.explode("held").alias("e")).select("class", "e.term", "e.gain")
        met = self._met(asked.filter("q = of").select("q", F.explode("held").alias("term")), rows.withColumnRenamed("class", "doc"), k)
        first = lambda rows, by: rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "doc"))).filter(F.col("_rank") <= k).drop("_rank")
        classes = first(met, "q").select(F.col("q").alias("of"), F.col("doc").alias("class"), "score")
        far = first(classes.join(docs.select("class", "doc"), "class").select("of", "doc", "score"), "of")
        far = asked.select("q", "of").join(far, "of").select("q", "doc", "score")
        return first(near.union(far.join(pairs, ["q", "doc"], "left_anti")), "q")

    def _met(self, wanted: DataFrame, gains: DataFrame, k: int) -> DataFrame:
        """``(q, doc, score)`` of blocks of queries ``(q, term)`` and of documents ``(doc, term, gain)``:
        at least the k best of each query."""
        kinds = {"q": dict(wanted.dtypes)["q"], "doc": dict(gains.dtypes)["doc"]}
        across, down = (max(1, -(-rows.select(c).distinct().count() // size)) for rows, c, size in ((gains, "doc", DOCUMENTS), (wanted, "q", QUERIES)))
        dealt = lambda rows, key, n, other, m: rows.withColumn(key[0], F.pmod(F.xxhash64(key[1]), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        asked, held = dealt(wanted, ("i", "q"), down, "j", across), dealt(gains, ("j", "doc"), across, "i", down)
        ship(self.spark)
        return asked.groupBy("i", "j").cogroup(held.groupBy("i", "j")).applyInPandas(lambda q, d: _best(q, d, k), f"q {kinds['q']}, doc {kinds['doc']}, score double")


def _best(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best documents of each query, by products of matrices of terms."""
    out = []
    held = held[held["term"].isin(asked["term"])]
    asked = asked[asked["term"].isin(held["term"])]
    q, of = np.unique(asked["q"].to_numpy(), return_inverse=True)
    docs, at = np.unique(held["doc"].to_numpy(), return_inverse=True)
    terms = {t: n for n, t in enumerate(held["term"].unique())}
    term_q, term_d, gain = asked["term"].map(terms).to_numpy(), held["term"].map(terms).to_numpy(), held["gain"].to_numpy()
    for start in range(0, len(q), STRIP):
        rows = min(STRIP, len(q) - start)
        score = np.zeros((rows, len(docs)))
        for first in range(0, len(terms), WIDE):
            wide = min(WIDE, len(terms) - first)
            a, b = np.zeros((rows, wide)), np.zeros((wide, len(docs)))
            x = (of >= start) & (of < start + rows) & (term_q >= first) & (term_q < first + wide)
            y = (term_d >= first) & (term_d < first + wide)
            a[of[x] - start, term_q[x] - first] = 1
            b[term_d[y] - first, at[y]] = gain[y]
            score += a @ b
        # one number orders by the score and, in reverse, by the key
        order = np.rint(score * 1e6).astype(np.int64) * len(docs) + np.arange(len(docs) - 1, -1, -1)
        order[score <= 0] = -1
        top = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < len(docs) else np.tile(np.arange(len(docs)), (rows, 1))
        r, c = np.repeat(np.arange(rows), top.shape[1]), top.ravel()
        hit = order[r, c] >= 0
        out.append(pd.DataFrame({"q": q[start + r[hit]], "doc": docs[c[hit]], "score": np.round(score[r[hit], c[hit]], 6)}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"q": asked["q"].iloc[:0], "doc": held["doc"].iloc[:0], "score": []})


def topk(spark: SparkSession, path: str, terms: list[str], k: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """``Index.topk`` of an index that is opened for this search."""
    return Index(spark, path, buckets).topk(terms, k)
