"""Record files: Parquet, JSON Lines, JSON, CSV, TSV, text and Arrow.

Every reader returns the record columns plus the order columns ``_file``, ``_block`` and ``_pos``: file name, place
of the split in the file, and a number that grows with the row inside the split. JSON records are one VARIANT
column ``v``, since their shape may change from row to row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.fixed import DIRECTORY_EXTENSIONS, EXTENSIONS, LINES_PER_CHUNK, MAX_CHARS, MIN_CHARS
from blockloom.functions.text import strip
from blockloom.operators.manifests import directory_value
from blockloom.plans.spec import extract, filter_length
from blockloom.session import materialize
from blockloom.sources.arrow_ipc import read_arrow
from blockloom.sources.ranges import SPLIT_BYTES, array_records, csv_records
from blockloom.sources.storage import literal, locate, plain

ORDER = ("_file", "_block", "_pos")
ROOT = "v"
FORMATS = ("parquet", "jsonl", "json", "csv", "tsv", "txt", "arrow")
TEXT_MODES = ("lines", "paragraphs", "file")


def _with_order(df: DataFrame) -> DataFrame:
    """Order columns for line-oriented files; the id only has to grow inside one split."""
    return df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
    )


# ---------------------------------------------------------------- formats

def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_block"),
        F.col("_metadata.row_index").alias("_pos"),
    )


# Records of any length, with NaN and the like; of repeated keys the last counts (see ``read_jsonl``).
JSON_OPTIONS = {"mode": "PERMISSIVE", "maxStringLen": str((1 << 31) - 1), "allowNonNumericNumbers": "true"}


#: A variant holds 128 MiB and takes no more than some three times the bytes of its text; shorter lines always fit.
VARIANT_FITS = 1 << 24


def _json_objects(line: Column) -> Column:
    """The object of a line, null if it has none; an object that is too large for a variant fails the job."""
    value = F.from_json(line, "variant", JSON_OPTIONS)
    large = value.isNull() & (F.octet_length(line) > VARIANT_FITS) & F.startswith(line, F.lit("{"))
    whole = F.from_json(line, "map<string,string>", JSON_OPTIONS).isNotNull()
    error = F.concat(F.lit("a JSON record does not fit a variant of 128 MiB; its line has bytes: "), F.octet_length(line))
    return F.when(large & whole, F.raise_error(error).cast("variant")).when(
        F.schema_of_variant(value).startswith("OBJECT"), value)


def read_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """One JSON object per line; blank, broken and non-object lines are skipped, objects beyond 128 MiB are an error."""
    return json_objects(_with_order(spark.read.text(list(paths))), *ORDER)


def json_objects(lines: DataFrame, *carry: str) -> DataFrame:
    """``(v, *carry)``: the objects of lines ``(value, *carry)``, of a table or a stream."""
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = strip(F.make_valid_utf8("value"))
    # A one-element list keeps the parse in one place; a filter after it would parse every line twice.
    return lines.select(F.explode(F.array_compact(F.array(_json_objects(text)))).alias(ROOT), *carry)


def read_json(spark: SparkSession, *paths: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """JSON files: those that start with ``[`` hold one array, all others are JSON Lines.

    An array is cut into its objects by byte ranges of ``split_bytes``, so a file of any size is read by many tasks; its
    other items are skipped, a broken array fails the job.
    """
    heads = _first_lines(spark, *paths).select("path", F.col("head").startswith("[").alias("is_array"))
    kinds = {row["is_array"] for row in heads.select("is_array").distinct().collect()}
    arrays = lined = list(paths)
    if len(kinds) == 2:  # only then do the file names matter
        named = heads.collect()
        arrays, lined = ([literal(r["path"]) for r in named if r["is_array"] == wanted] for wanted in (True, False))
    parts = []
    if True in kinds:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        text = F.make_valid_utf8(F.col("record").cast("string"))
        item = F.from_json(text, "variant", JSON_OPTIONS | {"mode": "FAILFAST"})
        parts.append(array_records(spark, arrays, split_bytes).select(item.alias(ROOT), *ORDER))
    if False in kinds:
        parts.append(read_jsonl(spark, *lined))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


HEAD_CHUNK = 1 << 16


def _head(source) -> str:
    """The first record: up to the first line end that is not inside quotes."""
    read = b""
    while True:
        chunk = source.read(HEAD_CHUNK)
        read += chunk
        quoted = False
        for i, part in enumerate(read.split(b'"')):
            quoted = i % 2 == 1
            if not quoted and b"\n" in part:
                end = sum(len(p) + 1 for p in read.split(b'"')[:i]) + part.index(b"\n")
                return read[:end].decode("utf-8", "replace").rstrip("\r")
        if not chunk:
            return read.decode("utf-8", "replace").rstrip("\r")


def _first_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, head)``: the first line of every file. The executors open the files, nothing else is read."""
    def heads(batches):
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                system, inside = locate(path)
                with system.open_input_file(inside) as source:
                    found.append(_head(source))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "head"])

    listing = spark.read.format("binaryFile").load(list(paths)).select("path")
    return listing.mapInArrow(heads, "path STRING, head STRING")


def same_header_groups(spark: SparkSession, pattern: str) -> list[list[str]]:
    """CSV files that share a header are read together; columns of different headers never mix."""
    heads = _first_lines(spark, pattern)
    if len(heads.select("head").distinct().limit(2).collect()) < 2:
        return [[pattern]]
    groups = heads.groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [[literal(p) for p in row["paths"]] for row in groups.orderBy("head").collect()]


def _column_type(found: T.DataType) -> T.DataType:
    """Numbers and booleans keep their inferred type, anything else is text."""
    return found if isinstance(found, (T.NumericType, T.BooleanType)) else T.StringType()


def read_csv(
    spark: SparkSession, *paths: str, delimiter: str = ",", schema: T.StructType | None = None, multiline: bool = True,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """CSV with a header. Rows with too many cells are skipped, missing cells are null.

    Files are cut into records by byte ranges of ``split_bytes``, also where quoted cells contain newlines, and each
    record is parsed by itself. Without ``schema`` the column types cost one extra pass. ``multiline=False`` leaves the
    splitting to Spark; use it when no quoted cell contains a newline.
    """
    options = dict(sep=delimiter, quote='"', escape='"', encoding="UTF-8")
    if not multiline:
        if schema is None:
            found = spark.read.options(**options, header=True, inferSchema=True).csv(list(paths)).schema
            schema = T.StructType([T.StructField(f.name, _column_type(f.dataType)) for f in found])
        df = _with_order(spark.read.schema(_with_extra(schema)).options(**options, header=True).csv(list(paths)))
        return df.where(F.col("_extra").isNull()).drop("_extra")
    text = F.rtrim(F.make_valid_utf8(F.col("record").cast("string")), F.lit("\r\n")).alias("text")
    lines = csv_records(spark, list(paths), delimiter, split_bytes).where("_pos > 0").select(*ORDER, text).where("text <> ''")
    options["multiLine"] = "true"
    if schema is None:
        head = _first_lines(spark, *paths).orderBy("path").select("head").limit(1)
        names = _read_strings(spark, head, **options, header=True).columns
        found = _read_strings(spark, lines.select("text"), **options, header=False, inferSchema=True).schema
        types = [_column_type(f.dataType) for f in found][:len(names)]
        types += [T.StringType()] * (len(names) - len(types))
        schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    parsed = F.from_csv("text", F.lit(_with_extra(schema).toDDL()), {k: str(v) for k, v in options.items()})
    rows = lines.select(parsed.alias("_row"), *ORDER)
    return rows.where(F.col("_row._extra").isNull()).select(*[F.col("_row")[n].alias(n) for n in schema.names], *ORDER)


def _with_extra(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_extra", T.StringType())])


def _read_strings(spark: SparkSession, lines: DataFrame, **options) -> DataFrame:
    """CSV records held in a column of text, read by Spark's reader."""
    encoder = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    reader = spark.read.options(**options)
    return reader._df(reader._jreader.csv(getattr(lines._jdf, "as")(encoder)))


def read_text(spark: SparkSession, *paths: str, mode: str = "paragraphs") -> DataFrame:
    """Text as one ``text`` record per line, per blank-line-separated paragraph, or per file; any newline style."""
    if mode == "lines":
        df = spark.read.text(list(paths))
        return _with_order(df).select(F.make_valid_utf8("value").alias("text"), *ORDER)
    if mode == "file":
        df = _with_order(spark.read.text(list(paths), wholetext=True))
        return df.select(F.regexp_replace(F.make_valid_utf8("value"), "\r\n?", "\n").alias("text"), *ORDER)
    if mode != "paragraphs":
        raise ValueError(f"unknown text mode {mode!r}; known: {', '.join(TEXT_MODES)}")
    return _paragraphs(read_text(spark, *paths, mode="lines"))


def _line_runs(batches):
    """Join the lines of each Arrow batch into runs that start at a blank line or where a split starts.

    ``_pid`` counts the blank lines of the split so far. Runs at the edge of a batch may go on in the next one.
    """
    file, block, blanks = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        text, files, blocks = batch.column("text"), batch.column("_file"), batch.column("_block").to_numpy()
        blank = pc.equal(text, "").to_numpy(zero_copy_only=False)
        changed = np.append(
            (files[0].as_py(), blocks[0]) != (file, block),
            (blocks[1:] != blocks[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False),
        )
        begins = np.flatnonzero(blank | changed | (np.arange(len(blank)) == 0))
        # Blank lines so far, counted anew from every split.
        seen = np.cumsum(blank) + (0 if changed[0] else blanks)
        before = np.where(changed, seen - blank, 0)
        pid = seen - np.maximum.accumulate(before)
        edges = np.append(begins, len(blank))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), text), "\n")
        place = pa.array(begins)
        edge = changed[begins] | np.append(changed[begins][1:], True)
        edge[0] = True
        yield pa.RecordBatch.from_arrays(
            [files.take(place), pa.array(blocks[begins]), batch.column("_pos").take(place), pa.array(pid[begins]),
             pa.array(edge), joined],
            names=["_file", "_block", "_pos", "_pid", "_edge", "text"],
        )
        file, block, blanks = files[-1].as_py(), blocks[-1], int(pid[-1])


def _paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs of lines in scan order.

    Lines are joined where they are read, without a shuffle. A paragraph is known by the number of blank lines
    before it in its file; only the runs at split and batch borders, a few per split, are brought together.
    (A reader that splits files at two newlines would be simpler, but it repeats records where a run of three
    or more newlines meets a split border.)
    """
    schema = "_file STRING, _block BIGINT, _pos BIGINT, _pid BIGINT, _edge BOOLEAN, text STRING"
    runs = materialize(lines.select("text", *ORDER).mapInArrow(_line_runs, schema), "runs")
    splits = runs.groupBy("_file", "_block").agg(F.max("_pid").alias("_blanks"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("_file", "_block", F.coalesce(F.sum("_blanks").over(earlier), F.lit(0)).alias("_base"))
    placed = runs.join(bases, ["_file", "_block"]).withColumn("_id", F.col("_base") + F.col("_pid"))
    inner = placed.where(~F.col("_edge")).select("_file", "_id", "text")
    parts = F.sort_array(F.collect_list(F.struct("_block", "_pos", "text")))
    merged = placed.where("_edge").groupBy("_file", "_id").agg(F.array_join(parts["text"], "\n").alias("text"))
    text = F.btrim("text", F.lit("\n"))
    return (
        inner.unionByName(merged).select(
            text.alias("text"), "_file", F.lit(0).cast("long").alias("_block"), F.col("_id").alias("_pos")
        ).where(F.col("text") != "")
    )


def read_records(
    spark: SparkSession, file_type: str, *paths: str, txt_mode: str = "paragraphs", csv_delimiter: str = ",",
    csv_schema: T.StructType | None = None,
) -> DataFrame:
    if file_type == "parquet":
        return read_parquet(spark, *paths)
    if file_type == "jsonl":
        return read_jsonl(spark, *paths)
    if file_type == "json":
        return read_json(spark, *paths)
    if file_type in ("csv", "tsv"):
        return read_csv(spark, *paths, delimiter="\t" if file_type == "tsv" else csv_delimiter, schema=csv_schema)
    if file_type == "txt":
        return read_text(spark, *paths, mode=txt_mode)
    if file_type == "arrow":
        return read_arrow(spark, *[plain(p) for p in paths])
    raise ValueError(f"unknown file type {file_type!r}; known: {', '.join(FORMATS)}")


# ---------------------------------------------------------------- discovery

def file_type_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
    return EXTENSIONS.get(suffix, "txt")


def discover(spark: SparkSession, path: str, forced_type: str | None = None) -> list[tuple[int, str, str]]:
    """``(rank, file type, path or glob)`` in document order; an input without files is an error.

    A directory is searched flat, by extension; files of one extension follow each other by name.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        raise FileNotFoundError(path)
    if not system.getFileStatus(root).isDirectory():
        return [(0, forced_type or file_type_of(path), literal(path))]
    extensions = DIRECTORY_EXTENSIONS
    if forced_type:
        extensions = [e for e, kind in EXTENSIONS.items() if kind == forced_type]
    found = []
    for rank, extension in enumerate(extensions):
        pattern = f"{literal(path.rstrip('/'))}/*{extension}"
        if len(system.globStatus(hadoop(pattern))):
            found.append((rank, EXTENSIONS[extension], pattern))
    if not found:
        raise FileNotFoundError(f"no supported files in {path}")
    return found


# ---------------------------------------------------------------- documents

def number_rows(df: DataFrame, keys: tuple[str, ...] = ("_rank",), out: str = "ord", per_file: bool = False) -> DataFrame:
    """Replace the order columns by one integer ``out`` in (keys, file, split, row) order.

    The input must be a written table, so both passes see the same rows. Texts are neither sorted nor windowed:
    one small aggregate gives the span of every split, its running total the base of the split.
    """
    spans = df.groupBy(*keys, "_file", "_block").agg(
        F.min("_pos").alias("_low"), (F.max("_pos") - F.min("_pos") + 1).alias("_size")
    )
    in_file = Window.partitionBy(*keys, "_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_base", F.coalesce(F.sum("_size").over(in_file), F.lit(0)))
    if not per_file:
        files = spans.groupBy(*keys, "_file").agg(F.sum("_size").alias("_file_size"))
        earlier = Window.orderBy(*keys, "_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
        files = files.select(*keys, "_file", F.coalesce(F.sum("_file_size").over(earlier), F.lit(0)).alias("_file_base"))
        spans = spans.join(files, [*keys, "_file"]).withColumn("_base", F.col("_base") + F.col("_file_base"))
    spans = spans.select(*keys, "_file", "_block", (F.col("_base") - F.col("_low")).alias("_shift"))
    numbered = df.join(spans, [*keys, "_file", "_block"]).withColumn(out, F.col("_pos") + F.col("_shift"))
    return numbered.drop("_block", "_pos", "_shift")


def read_documents(
    spark: SparkSession, path: str | list[str], spec: dict, file_type: str | None = None, txt_mode: str = "paragraphs",
    csv_delimiter: str = ",", csv_schema: T.StructType | None = None,
    min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """``(ord, text, …)`` of a file or directory: discover, read, extract, filter by length, number.

    Of several paths, the documents of the first come first.

    Every file type is compiled against its own schema. The extracted texts are written once to the shared
    folder, together with ``extra`` columns derived from the text; reading and extracting never happens twice.
    ``ord`` is unique and grows in document order; dropped records leave gaps.
    """
    extra = extra or {}
    parts = None
    inputs = [
        (number * len(DIRECTORY_EXTENSIONS) + rank, kind, group) for number, one in enumerate([path] if isinstance(path, str) else path)
        for rank, kind, pattern in discover(spark, one, file_type)
        for group in (same_header_groups(spark, pattern) if kind in ("csv", "tsv") else [[pattern]])
    ]
    for rank, kind, group in inputs:
        records = read_records(
            spark, kind, *group, txt_mode=txt_mode, csv_delimiter=csv_delimiter, csv_schema=csv_schema
        )
        root = ROOT if kind in ("json", "jsonl") else None
        docs = filter_length(extract(records, spec, carry=ORDER, root=root), min_chars, max_chars)
        docs = docs.select(
            F.lit(rank).alias("_rank"), "_file", "_block", "_pos", "text", *[c.alias(n) for n, c in extra.items()]
        )
        parts = docs if parts is None else parts.unionByName(docs)
    return number_rows(materialize(parts, "documents")).select("ord", "text", *extra)


def dataset_folders(spark: SparkSession, root: str, name: str, config: str | None = None, split: str = "train") -> list[str]:
    """The folders of a landed dataset, ``dataset=/config=/split=`` or ``dataset=/split=`` below ``root``, in name order.

    Only the wanted folders are listed. They may hold files of any format; all configurations are taken unless one is named.
    """
    row = spark.range(1).select(*[directory_value(F.lit(v or "")).alias(n) for n, v in (("d", name), ("c", config), ("s", split))]).first()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = hadoop(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = f"{literal(root.rstrip('/'))}/dataset={literal(row['d'])}"
    wanted = [f"{base}/config={literal(row['c']) if config is not None else '*'}/split={literal(row['s'])}"]
    if config is None:
        wanted.append(f"{base}/split={literal(row['s'])}")
    found = sorted(status.getPath().toString() for pattern in wanted for status in system.globStatus(hadoop(pattern)) or [])
    if not found:
        raise FileNotFoundError(f"no split {split!r} of dataset {name!r} below {root}")
    return found


def read_named_dataset(
    spark: SparkSession, root: str, name: str, config: str | None = None, split: str = "train"
) -> DataFrame:
    """A landed dataset in ``dataset=/config=/split=`` layout; only the wanted partitions are listed and read."""
    df = spark.read.option("basePath", root).parquet(root).where((F.col("dataset") == name) & (F.col("split") == split))
    return df.where(F.col("config") == config) if config is not None else df


def written_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """The written table of the lines of text files, for ``chunks_of``."""
    return materialize(read_text(spark, *paths, mode="lines"), "lines")


def chunk_lines(spark: SparkSession, *paths: str, chunk_size: int = LINES_PER_CHUNK) -> DataFrame:
    """``(file, chunk, text)``: every ``chunk_size`` lines of a text file joined into one document."""
    return chunks_of(written_lines(spark, *paths), chunk_size)


def chunks_of(lines: DataFrame, chunk_size: int = LINES_PER_CHUNK) -> DataFrame:
    numbered = number_rows(lines, keys=(), out="line_no", per_file=True)
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda e: e["text"]), "\n"
    )
    return (
        numbered.withColumn("chunk", F.expr(f"line_no div {int(chunk_size)}"))
        .groupBy(F.col("_file").alias("file"), "chunk").agg(joined.alias("text"))
    )


def order_chunks(chunks: DataFrame) -> DataFrame:
    """``(ord, text)`` of line chunks in file and chunk order; one row per file is windowed."""
    files = chunks.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return chunks.join(files, "file").select((F.col("_base") + F.col("chunk")).alias("ord"), "text")
