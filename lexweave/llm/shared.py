"""Small helpers that several operators use: written stages, hot-key joins, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A key with at least this share of all rows counts as hot; at most 1 / HOT_SHARE keys can.
HOT_SHARE = 1 / 1000
#: A key of fewer rows needs no treatment of its own, whatever its share.
HOT_LEAST = 100

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, with a subfolder for this application.

    Where that setting is missing, a session in local mode takes a temporary folder; any other is an error,
    as its executors wouldn't see the driver's folder.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_dir.setdefault(app, "") or _own_dir.update({app: tempfile.mkdtemp(prefix="lexweave-")}) or _own_dir[app]
    return f"{base.rstrip('/')}/{app}"


def small_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python tasks within 1,000 rows and 8 MB, so that long texts don't fill the workers' memory.

    Queries and pipeline stages call this; whoever calls the operators directly chooses.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run within go as soon as it ends: for results that are written or collected once."""
    before = spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANED, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage at a table that survives a lost executor. The files stay until forget() or
    until the application's subfolder is removed; the shuffle files that df took go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that saved() returned, once all that reads them has been written."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text. Pure ASCII texts take the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of left with right, which has one row per key and in ``weight`` the key's rows in left.

    Keys with HOT_SHARE of all rows, and HOT_LEAST at least, are joined by broadcast: as the weights sum up to ``total``,
    there are at most 1 / HOT_SHARE of them, whatever the input. The others take the usual shuffle.
    Both sides must be cheap to read twice (written tables).
    """
    is_hot = F.col(weight) >= F.lit(max(HOT_LEAST, total * HOT_SHARE))
    hot, cold = right.filter(is_hot), right.filter(~is_hot)
    keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(left.join(keys, key, "left_anti").join(cold, key))


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b), as (node, component = smallest node of it).

    Alternates the large-star and small-star steps of Kiveris et al. (2014); each step's edges are
    written, so that lineage stays short and nothing but two counts comes to the driver. A node that
    only has an edge to itself is a component of its own. Nulls are ignored.
    """
    edges = edges.select("a", "b").dropna()
    self_nodes = edges.filter("a = b").select(F.col("a").alias("node")).distinct()
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    for _ in range(most):
        if not (total := now.count()):
            break
        # each step is written, as one plan of both steps would hold the large star's four times
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("above")).filter("above > 0").select("u", F.least("u", "m").alias("m"), "above")
        low = saved(low, name)
        # the centre of a large star has many edges: these aren't gathered in one task
        large = hot_join(both.filter("v > u"), low, "u", "above", total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = saved(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        before, now = now, saved(small, name)
        forget(before, low, large)
        # stars only: no node has two smaller neighbours or is a centre's centre
        many = now.groupBy("u").agg(F.count("*").alias("c")).filter("c > 1").select("u")
        if now.select(F.col("v").alias("u")).join(now.select("u"), "u", "left_semi").unionByName(many).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = self_nodes.join(now.select(F.col("u").alias("node")).union(now.select("v")), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(roots).unionByName(alone)


#: The column that numbered() adds.
ROW = "__row"


#: Plans over one scan that keep each of its rows at most once, and as it is.
_ONE_TO_ONE = ("Project", "Filter", "SubqueryAlias", "View")


def _is_scan(docs: DataFrame) -> bool:
    """Whether docs is a deterministic chain of projections and filters over one scan of files."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in _ONE_TO_ONE:
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW, a number that a row has at every reading, however the files are split.

    It is the hash of the row's file plus its place there: rows of one file always differ, and among f
    files of r rows some two rows of different files share a number with a chance of f * f * r / 2**64.
    What isn't a chain of projections and filters over one scan of files (exploded or joined rows, say)
    is written first. A column of the name ROW is a user's own and is refused.
    """
    if ROW in (c.lower() for c in docs.columns):
        raise ValueError(f"the column {ROW} is reserved")
    try:
        place = docs.metadataColumn("_metadata") if _is_scan(docs) else None
    except AnalysisException:  # a relation without files
        place = None
    if place is None:
        docs = saved(docs, "rows")
        place = docs.metadataColumn("_metadata")
    return docs.withColumn(ROW, F.xxhash64(place["file_path"]) + place["row_index"])


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs, as numbered() returns them, whose ROW is in kept; one shuffle of the texts."""
    return docs.join(kept.select(ROW), ROW, "left_semi").drop(ROW)


def schema_with(df: DataFrame, added: dict[str, str]) -> StructType:
    """The schema of df without columns of the added names, then these names with their types."""
    new = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in added.items()))
    names = {name.lower() for name in added}
    return StructType([f for f in df.schema.fields if f.name.lower() not in names] + new.fields)
