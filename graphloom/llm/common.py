"""What the operators share: scratch tables in the shared folder, text columns, splits into batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

#: One word, as every contract of this package has it.
WORD = r"[^\x20\x09-\x0D]+"

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this session's own below ``spark.checkpoint.dir``, deleted when Python ends.

    Where the setting is absent a temporary folder takes its place, if all of Spark is in this process; a cluster needs the setting.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        _roots[app] = f"{base.rstrip('/')}/graphloom-{uuid.uuid4().hex[:12]}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _forget(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whatever its scheme."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of the shared store; none if there is no such folder."""
    fs, p = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the shared store, whole or not at all: written beside its name, then renamed."""
    fs, p = _fs(spark, path)
    draft = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")[1]
    stream = fs.create(draft, True)
    stream.write(text.encode())
    stream.close()
    if not fs.rename(draft, p):
        raise OSError(f"can't write {path}")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:8]}"


#: Settings under which tables are written here: Arrow batches of a bounded size, and hash joins where each partition of a side is small (others sort and can spill).
BOUNDED = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}


@contextmanager
def bounded(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """BOUNDED (and more settings) for the jobs started within, and what was set before afterwards."""
    own = BOUNDED | (more or {})
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, label)
    with bounded(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The name of the row number in frames whose columns are the caller's.
RID = "__graphloom_rid"


def _plain_scan(df: DataFrame) -> bool:
    """Whether each row of df is a row of a file: projections and filters over one file relation."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation")


def with_rid(df: DataFrame, name: str = RID) -> DataFrame:
    """Add a 64-bit row number that is the same in every scan of the same files, however Spark splits them.

    It is a hash of the file and the row's place in it. monotonically_increasing_id() depends on the split, and so on
    the executors there are. A frame that isn't a plain scan is written to the shared folder first. Joins
    on it should also compare the row's id where the input may exceed a few billion rows. A frame that has the
    column keeps it.
    """
    if name in df.columns:
        return df
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    if _plain_scan(df):
        try:
            return df.withColumn(name, place)
        except AnalysisException:  # a source without row numbers
            pass
    return materialize(df, "rows").withColumn(name, place)


def of_rows(rows: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """Join rows, from with_rid(), with (rid, doc_id, ...), by both columns."""
    right = chosen.withColumnsRenamed({"rid": f"{RID}_2", "doc_id": f"{RID}_id"}).hint("merge")
    return rows.join(right, (rows[RID] == right[f"{RID}_2"]) & rows["doc_id"].eqNullSafe(right[f"{RID}_id"]), how)


#: The largest bitmap of row numbers, and bits for each of them.
BITMAP_BITS, BITS_A_ROW = 25, 16


def bitmap(ids: DataFrame) -> tuple[DataFrame, int]:
    """(word, mask) of the row numbers in ids (rid), a bit for each by its leading bits, and how many bits those are.

    At most 2^BITMAP_BITS bits, so at most half a million rows: small enough to broadcast whatever the corpus. A row number whose
    bit is not set is not in ids; where ids are so many that most bits are set, it only spares less.
    """
    n = ids.count()
    bits = min(max((BITS_A_ROW * n).bit_length(), 12), BITMAP_BITS)
    place = F.shiftrightunsigned("rid", 64 - bits)
    words = ids.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(rid, {64 - bits}) & 63 as int))").alias("mask"))
    return words.groupBy("word").agg(F.bit_or("mask").alias("mask")), bits


def _marked(rows: DataFrame, ids: DataFrame, name: str) -> tuple[DataFrame, str]:
    """rows with the bitmap's word for each, and the value of its bit."""
    words, bits = bitmap(ids)
    place = f"shiftrightunsigned({name}, {64 - bits})"
    words = words.withColumnsRenamed({"word": f"{RID}_word", "mask": f"{RID}_mask"})
    marked = rows.withColumn(f"{RID}_word", F.expr(f"shiftright({place}, 6)")).join(F.broadcast(words), f"{RID}_word", "left")
    return marked, f"coalesce({RID}_mask & shiftleft(1L, cast({place} & 63 as int)), 0L)"


def may_be_in(rows: DataFrame, ids: DataFrame, name: str = "rid") -> DataFrame:
    """rows without most of those whose row number, in the column of that name, is not in ids (rid)."""
    marked, bit = _marked(rows, ids, name)
    return marked.where(f"{bit} <> 0").select(*(rows[c] for c in rows.columns))


def is_not_in(rows: DataFrame, ids: DataFrame, name: str = "rid") -> DataFrame:
    """Most of the rows whose row number is not in ids (rid): those that may_be_in() leaves out."""
    marked, bit = _marked(rows, ids, name)
    return marked.where(f"{bit} = 0").select(*(rows[c] for c in rows.columns))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows, from with_rid(), but for those in gone (rid, doc_id); only rows that a bitmap of gone can't rule out are shuffled."""
    gone = materialize(gone.select("rid", "doc_id"), "gone")
    return is_not_in(rows, gone, RID).unionByName(of_rows(may_be_in(rows, gone, RID), gone, "left_anti"))


#: Tables below this many bytes are often one row group, which one task would read.
SPREAD_BYTES = 24 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores, for work in Python that follows; a large one is left as it is split.

    What follows may run long after this call, so Arrow batches are bounded for the session, unless it has a bound of its own.
    """
    spark = df.sparkSession
    for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, BOUNDED[k])
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if cores > 1 and int(str(size)) < SPREAD_BYTES else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def batches_by_id(docs: DataFrame, n: int, key: str = "doc_id") -> list[DataFrame]:
    """Split a table into n batches by ranges of an id, nulls in the first; a stand-in for n arrivals over time."""
    lo, hi = docs.agg(F.min(key), F.max(key)).first()
    if lo is None or n < 2 or lo == hi:
        return [docs]
    cuts = [lo + (hi - lo) * i // n for i in range(1, n)]
    ends = [None, *cuts, None]
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        cond = F.lit(True) if a is None else F.col(key) > a
        cond = cond if b is None else cond & (F.col(key) <= b)
        out.append(docs.where(cond | F.col(key).isNull() if a is None else cond))
    return out


#: Rows of a per-source (or similarly small) table that may be broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 50_000


def if_small(df: DataFrame, n: int) -> DataFrame:
    """Marked for broadcast if its row count, n, is within the bound."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


#: Rows of one key that one task numbers, about.
RANK_ROWS = 100_000


def salted_rank(df: DataFrame, keys: list[str], order: list[str], most: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``rank``, a number from 0 that is unique and gapless within each combination of keys.

    A window over the keys alone would bring a hot key to one task. Rows are numbered within (keys, salt),
    and the salts' counts give each salt its first number. There are as many salts as the largest key, of ``most`` rows, has
    RANK_ROWS, and 64 at least. Ranks are deterministic when ``order`` is unique within the keys. ``ties`` order what order
    leaves equal, and nothing else: rows of equal order get the same ranks in turn, whatever their ties are.
    """
    from pyspark.sql import Window as W

    salts = max(64, -(-most // RANK_ROWS))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)))
    first = first.select(*keys, "_salt", F.coalesce("_first", F.lit(0)).alias("_first"))
    own = salted.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order, *ties)) - 1)
    on = reduce(lambda a, b: a & b, [own[k].eqNullSafe(first[k]) for k in [*keys, "_salt"]])
    joined = own.join(first, on, "inner")
    return joined.select(*[own[c] for c in df.columns], (own["_own"] + first["_first"]).cast("long").alias("rank"))
