"""What the operators share: written tables in the shared folder and connected components."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only on a single machine (a local master, as in tests) that names none a temporary folder is made and set; a cluster
    must name one.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="axonframe-"))
    return spark.sparkContext.getCheckpointDir()


def trimmed(spark: SparkSession) -> str | None:
    """Has the driver's JVM give freed native memory back to the system, which glibc else keeps for each of some hundred threads; what the JVM says of it.

    By the command that ``jcmd`` knows as ``System.trim_native_heap``: None, and nothing done, where the JVM has none (before 17.0.9, or not on Linux).
    """
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named, lang = jvm.java.lang.Class.forName, jvm.java.lang
    try:
        types, values = new(lang.Class, 4), new(lang.Object, 4)
        for k, kind in enumerate(["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]):
            types[k] = named(kind)
        for k, value in enumerate([jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new(lang.Object, 0), new(lang.String, 0)]):
            values[k] = value
        return named("javax.management.MBeanServer").getMethod("invoke", types).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return None


def saved(df: DataFrame, name: str, rows: int | None = None, each: int = 5_000) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts the lineage, survives lost executors.

    ``rows``, about how many there are: then no more files, and tasks, than one for ``each`` of them, as a small table dealt
    over many partitions would leave as many tiny files. A large table keeps its partitions.
    The reader's :attr:`saved_path` lets :func:`dropped` remove the files once nothing needs them.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(rows // each + 1)).write.parquet(path)
    trimmed(df.sparkSession)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.saved_path = path
    return back


def dropped(*frames: DataFrame | None) -> None:
    """Removes the files of :func:`saved` tables that no later step reads."""
    for df in frames:
        path = getattr(df, "saved_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def hot_keys(counts: DataFrame, on: list[str], total: int, least: int = 500, most: int = 4096) -> DataFrame:
    """Keys of many rows and the number of ``parts`` to deal them to, from ``on, m`` (rows of a key, or a bound of them).

    Hot is a key with more than ``least`` rows and more than one ``most``-th of the ``total``: fewer than ``most`` keys, which are broadcast.
    """
    share = max(least, -(-total // most))
    return F.broadcast(counts.filter(F.col("m") > share).select(*on, F.ceil(F.col("m") / share).cast("int").alias("parts")))


def salted_join(rows: DataFrame, keyed: DataFrame, on: list[str], hot: DataFrame, by: list[str] | None = None, hint: str | None = None) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key, or a few, without a task that gets a hot key's rows.

    Rows of a key in ``hot`` (:func:`hot_keys`) are dealt by a hash (of the columns in ``by``, or of all) to its parts, and the key's row in ``keyed`` goes to each. ``hint``: of the join.
    """
    dealt = rows.join(hot, on, "left").withColumn("_part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*(by or rows.columns)), F.col("parts"))).cast("int")).drop("parts")
    each = keyed.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(each.hint(hint) if hint else each, [*on, "_part"]).drop("_part")


def maybe_among(rows: DataFrame, keys: DataFrame, on: str, n: int) -> DataFrame:
    """``rows`` without most of those whose ``on`` isn't among ``keys`` (``n`` of them), so that a join that follows shuffles little else.

    By a bitmap of hashes, 16 bits a key and 8 MB at most, which is broadcast in pieces of 4 KB: all rows of a key pass, and about one of 16 others (more over 4 million keys).
    It only saves work: the join still has to tell. Where the two columns' types differ, or hashes may tell equal values apart, all rows pass.
    """
    kind = dict(keys.dtypes)[on]
    if kind != dict(rows.dtypes)[on] or kind not in ("tinyint", "smallint", "int", "bigint", "string"):
        return rows
    bits = min(26, max(15, (16 * n).bit_length()))
    at = F.pmod(F.xxhash64(on), F.lit(1 << bits))
    maps = keys.select(at.alias("_at")).groupBy(F.shiftright("_at", 15).alias("_piece")).agg(F.bitmap_construct_agg(F.col("_at") % 32768).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = rows.withColumn("_at", at)
    return known.join(F.broadcast(maps), (F.shiftright("_at", 15) == F.col("_piece")) & (F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1), "left_semi").drop("_at")


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has long columns ``a`` and ``b`` (``rows``: about how many, see :func:`saved`). Returns ``id`` and ``component`` (the smallest id reachable)
    for each id that has a link to another one. Every round is a partial aggregation and an equi-join on the
    vertex, with the neighbours of a hub dealt to many tasks; its table is written to the shared folder and the one before it removed. A hub's neighbours are
    never gathered in one row, and no links come to the driver. No links give no rows.
    """
    now = saved(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", rows)
    was = None
    while True:
        print_ = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_ == was:
            break
        was = print_
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("m"))
        star = salted_join(both.filter("v > u"), low.select("u", F.least("u", "least").alias("least")), ["u"], hot_keys(low, ["u"], 2 * print_[0]))
        large = saved(star.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "links", print_[0])
        low = large.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("m"))
        star = salted_join(large, low.select("u", "least"), ["u"], hot_keys(low, ["u"], print_[0])).filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        after = saved(star.union(low.select("u", F.col("least").alias("v"))).distinct(), "links", print_[0])
        dropped(now, large)
        now = after
    both = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")))
    return both.groupBy("id").agg(F.min("component").alias("component"))
