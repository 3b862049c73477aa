"""A persisted inverted index: written once, asked by many queries.

Postings are rows (term, key, f0.. uses in each column, d the row's words in all columns), sorted by term
in range partitions, so that a query's prefixes prune files and row groups by their statistics and only
the postings of its words are read. One row of statistics (rows, mean length) lies beside them.
A term of very many rows is spread by its key over as many ranges as it needs."""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkatlas.functions import stemming
from talkatlas.functions.text import words
from talkatlas.operators.ranking import B, K1, query_prefixes


def shared_folder(spark: SparkSession) -> str:
    """A folder that all machines see: spark.checkpoint.dir; in local mode without one, a temporary folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="talkatlas-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def fingerprint(table: DataFrame) -> str:
    """A digest of a table's files: paths, sizes and times of change."""
    jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in sorted(table.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(seen).encode()).hexdigest()[:24]


def plain_terms(rows: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """key, d, term, column for every word (two letters or more): runs of ASCII letters and digits."""
    cut = rows.select(key, *[words(F.coalesce(F.col(t), F.lit(""))).alias(f"w{i}") for i, t in enumerate(texts)])
    length = sum((F.size(f"w{i}") for i in range(len(texts))), F.lit(0)).cast("double").alias("d")

    def of(i: int) -> Callable[[Column], Column]:
        return lambda w: F.struct(w.alias("term"), F.lit(i).alias("column"))

    tagged = F.concat(*[F.transform(f"w{i}", of(i)) for i in range(len(texts))])
    return cut.select(key, length, F.explode_outer(tagged).alias("x")).select(key, "d", "x.term", "x.column")


def stemmed_terms(rows: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """As plain_terms, with Unicode words without diacritics, stemmed; in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, terms, column = [], [], [], []
            for r, cells in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)):
                found = [(i, stemming.stem(w)) for i, cell in enumerate(cells) for w in stemming.index_words(cell)]
                found = found or [(None, None)]
                at += [r] * len(found)
                size += [float(sum(t is not None for _, t in found))] * len(found)
                terms += [t for _, t in found]
                column += [i for i, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(size, pa.float64()), pa.array(terms, pa.string()), pa.array(column, pa.int32())], names=[key, "d", "term", "column"])

    shape = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("d", T.DoubleType()), T.StructField("term", T.StringType()), T.StructField("column", T.IntegerType())])
    return rows.select(key, *texts).mapInArrow(run, shape)


ANALYZERS: dict[str, tuple[Callable[[DataFrame, str, list[str]], DataFrame], Callable[[str], list[str]]]] = {
    "plain": (plain_terms, query_prefixes),
    "stemmed": (stemmed_terms, lambda q: list(dict.fromkeys(stemming.stem(w) for w in stemming.index_words(q) if len(w) > 1))),
}


@dataclass
class Index:
    """postings (term, key, f0.., d), the number of rows, their mean length, the indexed columns and the analyzer."""

    postings: DataFrame
    key: str
    texts: list[str]
    rows: int
    mean: float
    analyzer: str

    def hits(self, query: str, match: list[str] | None = None) -> tuple[DataFrame, int]:
        """(key, d, one column f0.. for each query prefix with its uses in the matched columns; the number of prefixes)."""
        prefixes = ANALYZERS[self.analyzer][1](query)
        use = sum((F.col(f"f{i}") for i, t in enumerate(self.texts) if match is None or t in match), F.lit(0))
        wanted = F.lit(False)
        for p in prefixes:
            wanted = wanted | F.col("term").startswith(p)
        per = [F.sum(F.when(F.col("term").startswith(p), use).otherwise(0)).alias(f"q{j}") for j, p in enumerate(prefixes)]
        found = self.postings.where(wanted).groupBy(self.key).agg(F.first("d").alias("d"), *(per or [F.lit(0).alias("q")]))
        return found, len(prefixes)

    def matches(self, query: str, match: list[str] | None = None) -> DataFrame:
        """key of every row that holds a word with a prefix of the query: complete and unranked."""
        found, n = self.hits(query, match)
        return found.where(sum((F.col(f"q{j}") for j in range(n)), F.lit(0)) > 0).select(self.key)

    def bm25(self, query: str, within: DataFrame | None = None, match: list[str] | None = None) -> DataFrame:
        """key and score (higher is better) of the rows that match; statistics are those of all rows."""
        found, n = self.hits(query, match)
        seen = found.agg(*[F.count_if(F.col(f"q{j}") > 0).alias(f"n{j}") for j in range(n)]).first() if n else None
        score, hit = F.lit(0.0), F.lit(False)
        for j in range(n):
            nj = seen[f"n{j}"]
            idf = math.log((self.rows - nj + 0.5) / (nj + 0.5)) if self.rows else 0.0
            f = F.col(f"q{j}")
            score = score + F.lit(idf if idf > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.lit(self.mean or 1.0)))
            hit = hit | (f > 0)
        out = found.where(hit).select(self.key, score.alias("score"))
        return out if within is None else out.join(within.select(self.key).distinct(), self.key, "left_semi")


def write(rows: DataFrame, key: str, texts: list[str], path: str, analyzer: str = "plain") -> Index:
    """The index of rows' texts at a path in shared storage; a finished one of the same name is used as it is."""
    spark = rows.sparkSession
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/statistics/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        terms = ANALYZERS[analyzer][0](rows, key, texts)
        per = terms.where(F.length("term") > 1).groupBy("term", key).agg(*[F.count_if(F.col("column") == i).alias(f"f{i}") for i in range(len(texts))], F.first("d").alias("d"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        per.repartitionByRange(parts, "term", key).sortWithinPartitions("term", key).write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        sizes = terms.groupBy(key).agg(F.first("d").alias("d"))
        # the statistics are written last: an index without them isn't finished
        sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean")).write.mode("overwrite").parquet(f"{path}/statistics")
    stats = spark.read.parquet(f"{path}/statistics").first()
    return Index(spark.read.parquet(f"{path}/postings"), key, texts, stats.n, stats.mean or 0.0, analyzer)


_OPEN: dict[tuple, Index] = {}


def of_table(table: DataFrame, key: str, texts: list[str], analyzer: str = "plain") -> Index:
    """The index of a table of files, kept in the shared folder under the files' fingerprint: a changed file makes a new one."""
    spark = table.sparkSession
    name = hashlib.sha256(repr((fingerprint(table), key, texts, analyzer)).encode()).hexdigest()[:24]
    at = (spark.sparkContext.applicationId, name)
    if at not in _OPEN:
        _OPEN[at] = write(table, key, texts, f"{shared_folder(spark)}/talkatlas-index/{name}", analyzer)
    return _OPEN[at]
