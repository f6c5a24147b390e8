"""Files in and out: text folders, CSV, JSON lines, partitioned tables."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.storage import work_folder


def read_texts(spark: SparkSession, folder: str, extension: str = ".txt") -> tuple[DataFrame, DataFrame]:
    """(good, bad): doc_id (the file's name) and text of each UTF-8 file, and the names of the others."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(folder)
    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.col("content").cast("string").alias("text"))
    valid = F.is_valid_utf8("text")
    return named.where(valid), named.where(~valid).select("doc_id", F.lit("not UTF-8").alias("error"))


def write_texts(lines: DataFrame, path: str, by: str, file_bytes: int, key: str | None = None) -> None:
    """Write lines(by, value) as text, a folder for each by, in files of about file_bytes (a longer line is one file at least).

    Each group's bytes give the number of its files. A line's file follows from its value and its key, so a task that runs again deals
    lines as before. Without a key the line's place in the input stands for it, which must then be the same in each run.
    """
    size = F.coalesce(F.octet_length("value"), F.lit(0)) + 1
    files = lines.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.sum(size) / file_bytes).alias("_files"))
    keyed = lines.select(by, "value", (F.col(key) if key else F.monotonically_increasing_id()).alias("_key"))
    dealt = keyed.join(files, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_file", F.pmod(F.xxhash64("value", "_key"), F.col("_files"))).select(by, "_file", "value")
    dealt.repartition(by, "_file").write.partitionBy(by, "_file").text(path)


def intake(name: Column, size: Column, head: Column, extensions: list[str], office: list[str], limit: int) -> Column:
    """What is wrong with a file that came in, else null; the first fault counts. head: its first two bytes."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return (
        F.when(name.isNull() | (name == ""), "no name").when(~ext.isin(extensions), "extension").when(size == 0, "empty")
        .when(size > limit, "too large").when(ext.isin(office) & (head != "PK"), "not an office file")
    )


def copy_ready(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows as a text loader wants them: nested values as JSON, times as ISO, decimals as text; null stays null."""

    def text(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, (T.DecimalType, T.DateType)):
            c = c.cast("string")
        return c.alias(f.name)

    return df.select(*[text(df.schema[c]) for c in (columns or df.columns)])


def by_csv(df: DataFrame) -> DataFrame:
    path = work_folder(df.sparkSession, "csv")
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)


def by_json(df: DataFrame) -> DataFrame:
    path = work_folder(df.sparkSession, "json")
    exact = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    df.write.options(**exact).json(path)
    return df.sparkSession.read.options(**exact).schema(df.schema).json(path)


def read_envelope(spark: SparkSession, path: str, schema: str, field: str = "data") -> DataFrame:
    """Rows of JSON files that hold {"data": [row, ...]}."""
    return spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline(field))


def write_monthly(df: DataFrame, path: str, ts: str, order: list[str], spread: int = 8) -> None:
    """One folder a month, rows ordered inside each file. A month is dealt over `spread` tasks by a hash, so a hot month is no hot task."""
    months = df.withColumn("month", F.date_format(ts, "yyyyMM")).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(spread)))
    months.repartition("month", "_salt").drop("_salt").sortWithinPartitions("month", *order).write.partitionBy("month").parquet(path)


def rebuild(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions that df has rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def bins(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Files that go together, up to most bytes, the largest first into the fullest bin that has room; what stays alone is left out."""
    out: list[tuple[int, list[str]]] = []
    free: list[tuple[int, int]] = []  # (room, bin), ascending
    for name in sorted(sizes, key=lambda n: (-sizes[n], n)):
        at = bisect_left(free, (sizes[name], -1))
        if at < len(free):
            room, k = free.pop(at)
            out[k] = out[k][0] + sizes[name], [*out[k][1], name]
        else:
            room, k = most, len(out)
            out.append((sizes[name], [name]))
        insort(free, (room - sizes[name], k))
    return [names for _, names in out if len(names) > 1]


def compact(spark: SparkSession, path: str, file_bytes: int = 128 << 20, order: list[str] | None = None, partition: dict[str, str] | None = None) -> int:
    """Bring the small files of a Parquet table, or of one partition of it, together into files of about file_bytes; how many went.

    Only files under file_bytes are read, those of a folder packed by best fit; files of that size or more, and one that nothing can go
    with, stay as they are. With order the rows of a new file are sorted by it. New files are written hidden; a list of the old
    ones, written last, makes it certain: from then on the old ones go and the new ones appear, by this call or, after a break,
    by the next one. Readers should not be at it in between.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    root = "/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in (partition or {}).items())])
    fs = at(root).getFileSystem(spark._jsc.hadoopConfiguration())
    hidden = f"{root}/_compact"

    def finish() -> None:
        """What a list says: old files go, new ones take their places."""
        if fs.exists(at(f"{hidden}/old")):
            for r in spark.read.text(f"{hidden}/old").collect():  # as many as there were small files
                fs.delete(at(r["value"]), False)
            for s in fs.globStatus(at(f"{hidden}/new/_bin=*/part-*")) or []:
                folder, _, k = s.getPath().getParent().getName().removeprefix("_bin=").rpartition("-")
                fs.rename(s.getPath(), at(f"{bytes.fromhex(folder).decode() or root}/{s.getPath().getName().replace('part-', f'part-{k}-', 1)}"))
        fs.delete(at(hidden), True)

    finish()
    small: dict[str, dict[str, int]] = {}
    found = fs.listFiles(at(root), True)
    while found.hasNext():
        f = found.next()
        name, folder = f.getPath().getName(), f.getPath().getParent().toString()
        if name[0] not in "._" and "/_" not in folder.removeprefix(at(root).toString()) and f.getLen() < file_bytes:
            small.setdefault(folder, {})[f.getPath().toString()] = f.getLen()
    packed = [(name, f"{folder.encode().hex()}-{k}") for folder, sizes in small.items() for k, names in enumerate(bins(sizes, file_bytes)) for name in names]
    if not packed:
        return 0
    # columns of the partition are in the folders' names, not in the files
    inside = [c for c in spark.read.parquet(packed[0][0]).columns if f"/{c}=" not in packed[0][0]]
    of = spark.createDataFrame(packed, "_file string, _bin string")  # a row a small file
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), r"^(\w+):/+", "$1:/")
    rows = spark.read.parquet(*[n for n, _ in packed]).select(*[F.col(f"`{c}`") for c in inside], plain(F.col("_metadata.file_path")).alias("_file"))
    rows = rows.join(of.withColumn("_file", plain(F.col("_file"))), "_file").drop("_file").repartition(len({b for _, b in packed}), "_bin")
    rows.sortWithinPartitions("_bin", *(order or [])).write.partitionBy("_bin").parquet(f"{hidden}/new")
    of.select(F.col("_file").alias("value")).coalesce(1).write.text(f"{hidden}/old.tmp")
    fs.rename(at(f"{hidden}/old.tmp"), at(f"{hidden}/old"))
    finish()
    return len(packed)


FORMS = ("csv", "text", "binary")


def export(df: DataFrame, path: str, form: str) -> None:
    """As CSV with a head, as lines of text (columns between tabs; null is \\N; backslash, tab and line end escaped), or binary (Parquet)."""
    if form == "csv":
        df.write.option("header", True).csv(path)
    elif form == "text":
        plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
        ready = copy_ready(df)
        ready.select(F.concat_ws("\t", *[F.coalesce(plain(F.col(f"`{c}`").cast("string")), F.lit("\\N")) for c in ready.columns]).alias("value")).write.text(path)
    elif form == "binary":
        df.write.parquet(path)
    else:
        raise ValueError(f"unknown form {form}")


def exported(spark: SparkSession, path: str, form: str, schema: T.StructType) -> DataFrame:
    """What export wrote, for columns of plain types."""
    if form == "csv":
        return spark.read.option("header", True).schema(schema).csv(path)
    if form == "binary":
        return spark.read.schema(schema).parquet(path)
    cells = F.split("value", "\t")
    sign = lambda c, a, b: F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\" + a, "$1" + b)
    plain = lambda c: F.replace(sign(sign(sign(c, "t", "\t"), "n", "\n"), "r", "\r"), F.lit("\\\\"), F.lit("\\"))
    return spark.read.text(path).select(*[F.when(F.get(cells, i) != "\\N", plain(F.get(cells, i))).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])


def write_parsed(rows: DataFrame, path: str, preview: int = 300) -> None:
    """rows(file, text, markdown) with a preview, by full file name, so files that share a stem do not meet."""
    rows.select("file", "text", "markdown", F.substring("text", 1, preview).alias("text_preview")).write.parquet(path)
