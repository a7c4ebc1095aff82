"""Readers and writers of the tables: Parquet, CSV and TSV with their quirks, Feather, logs, and shared checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, ``spark.checkpoint.dir``; a temporary one only on a single machine that names none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="axonframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that the cluster shares (:func:`shared_dir`)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the folder that the cluster shares, read back: for tables of many rows, which :func:`checkpointed` keeps unpacked."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_parquet(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Parquet files of one kind as one table, pruned to the columns; files may differ in their other columns."""
    df = spark.read.option("mergeSchema", "true").parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def read_trials(spark: SparkSession, path: str, keys: dict[str, str] | None = None) -> DataFrame:
    """A CSV with a header, any ``#`` lines before it, and metrics in all columns but the keys.

    Blank is null (not computed), NaN stays NaN (computed but undefined); metrics are doubles, keys as given.
    """
    keys = keys or {"arm": "string", "trial": "int"}
    text = spark.read.option("header", True).option("comment", "#").option("escape", '"').option("multiLine", True).csv(path)
    return text.select(*[F.col(f"`{c}`").cast(keys[c]).alias(c) if c in keys else F.expr(f"try_cast(`{c}` as double)").alias(c) for c in text.columns])


def read_positional(spark: SparkSession, path: str, columns: list[tuple[str, str]], sep: str = "\t", header: bool = True) -> DataFrame:
    """A delimited file by column position: short rows have nulls at the end, fields that can't be cast are null."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n, _ in columns])
    df = spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    return df.select(*[F.expr(f"try_cast(trim(`{n}`) as {t})").alias(n) for n, t in columns])


def read_piped_log(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    """Rows of a console log with ``|`` between fields; lines that don't have as many fields, or no number where one is due, are left out."""
    parts = F.split("value", r"\|")
    rows = spark.read.text(path).filter(F.size(parts) >= len(columns))
    out = rows.select(*[F.expr(f"try_cast(trim(get(split(value, '[|]'), {k})) as {t})").alias(n) for k, (n, t) in enumerate(columns)])
    first_number = next((n for n, t in columns if t != "string"), columns[0][0])
    return out.filter(F.col(first_number).isNotNull())


EDGE_RECORD = [("pre", "<i8"), ("post", "<i8"), ("weight", "<i4")]


class EdgeRecords(DataSource):
    """Files of 20-byte edge records after an 8-byte count, read in byte ranges: a file of any size is many tasks."""

    @classmethod
    def name(cls) -> str:
        return "edge_records"

    def schema(self) -> str:
        return "pre long, post long, weight int"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _EdgeReader(self.options["path"], int(self.options.get("rows", 4_000_000)))


class _EdgeReader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def _files(self) -> tuple[object, list[str]]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", ".")))
        return system, [path]

    def partitions(self) -> list[InputPartition]:
        system, files = self._files()
        out = []
        for f in files:
            with system.open_input_file(f) as h:
                n = int.from_bytes(h.read(8), "little")
                if h.size() < 8 + 20 * n:
                    raise ValueError(f"{f}: {n} records are announced, but the file ends before")
            out += [InputPartition((f, at, min(self.rows, n - at))) for at in range(0, n, self.rows)]
        return out

    def read(self, partition: InputPartition) -> Iterator[object]:
        import numpy as np
        import pyarrow as pa

        f, at, n = partition.value
        with self._files()[0].open_input_file(f) as h:
            for k in range(at, at + n, 500_000):
                some = min(500_000, at + n - k)
                a = np.frombuffer(h.read_at(20 * some, 8 + 20 * k), np.dtype(EDGE_RECORD))
                yield pa.RecordBatch.from_arrays([pa.array(a[c].copy()) for c, _ in EDGE_RECORD], [c for c, _ in EDGE_RECORD])


def read_edge_records(spark: SparkSession, path: str, rows: int = 4_000_000) -> DataFrame:
    """Binary files of 20-byte edge records after an 8-byte count, ``rows`` of them a task; ``path``: a file or a folder, local or a URI."""
    spark.dataSource.register(EdgeRecords)
    return spark.read.format("edge_records").option("path", path).option("rows", rows).load()


def write_edge_records(edges: DataFrame, path: str) -> None:
    """Edges as Parquet, the engine's own edge format: columnar, split by rows, no count to patch afterwards."""
    edges.select(F.col("pre").cast("long"), F.col("post").cast("long"), F.col("weight").cast("int")).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_feather(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Arrow IPC files, a file a task, in their own batches; validity is kept, so nulls are nulls."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path)

    def schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pa.ipc.open_file(pa.BufferReader(c.as_buffer())).schema.serialize().to_pybytes() for c in b.column(0)], pa.binary())], ["schema"])

    head = files.select("content").mapInArrow(schemas, "schema binary").first()  # the file stays in its task
    if head is None:
        raise FileNotFoundError(path)
    schema = pa.ipc.read_schema(pa.py_buffer(bytes(head.schema)))
    plain = pa.schema([(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in schema if not columns or f.name in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                reader = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
                for k in range(reader.num_record_batches):
                    t = pa.Table.from_batches([reader.get_batch(k)]).select(plain.names).cast(plain)
                    yield from t.to_batches()

    return files.select("content").mapInArrow(run, from_arrow_schema(plain))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole text files: UTF-16 by its byte-order mark, else UTF-8 without one; bytes that are neither become U+FFFD."""
    head = F.substring("content", 1, 2)
    utf16 = (head == F.lit(bytearray(b"\xff\xfe"))) | (head == F.lit(bytearray(b"\xfe\xff")))
    text = F.when(utf16, F.expr("decode(content, 'UTF-16')")).otherwise(F.regexp_replace(F.expr("try_validate_utf8(cast(content as string))"), "^\ufeff", ""))
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.coalesce(text, F.expr("make_valid_utf8(cast(content as string))")).alias("text"))


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log in one line each, fields apart by `` | ``; a run never rewrites the lines before it."""
    df.select(F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.mode("append").text(path)


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n#') else text


def quoted(c: Column) -> Column:
    """A CSV cell: in quotes, with its own doubled, where it holds a comma, a quote, a line end or ``#``; null is blank."""
    return F.when(c.isNull(), "").when(c.rlike('[,"\r\n#]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def write_summary(df: DataFrame, path: str, facts: dict[str, object]) -> None:
    """A small table as one CSV file under lines ``# key,value``; read it back with :func:`read_trials`."""
    head = df.sparkSession.createDataFrame([(k, f"# {n},{v}") for k, (n, v) in enumerate(facts.items())] + [(len(facts), ",".join(map(_quoted, df.columns)))], "k int, value string")
    body = df.select(F.lit(len(facts) + 1).alias("k"), F.concat_ws(",", *[quoted(F.col(f"`{c}`").cast("string")) for c in df.columns]).alias("value"))
    head.union(body).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet, left alone if it is there already unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "ignore").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, legend: dict[str, str] | None = None) -> None:
    """A CSV with a header, null blank and NaN as NaN; a legend of columns goes into a folder beside it."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("nanValue", "NaN").csv(path)
    if legend:
        df.sparkSession.createDataFrame(sorted(legend.items()), "column string, meaning string").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}-legend")


def markdown(df: DataFrame, digits: int = 4, most: int = 10_000) -> str:
    """A small result as a Markdown table; one of over ``most`` rows is refused, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no table to be read; write them to a file")
    show = lambda v: "" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])
