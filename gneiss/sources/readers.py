"""Readers: projected parquet, delimited text, GCT, SOFT, JSON parameters, HDF5 blocks, manifests."""

from __future__ import annotations

import importlib.util
import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.reshape import first_of_each, melt


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, optional: Sequence[str] = ()) -> DataFrame:
    """The named columns only; ``optional`` ones come out as NULL strings where the file lacks them."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    there = {c.lower() for c in df.columns}
    return df.select(
        *[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`") if c.lower() in there else F.lit(None).cast("string").alias(c) for c in optional]
    )


def feature_columns(df: DataFrame, pattern: str = r"(?i)^ENSG\d+(\.\d+)?$") -> list[str]:
    """Columns whose name is a feature id."""
    return [c for c in df.columns if re.match(pattern, c)]


def delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; without a schema all columns are strings (no inference pass)."""
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def wide_delimited(spark: SparkSession, path: str, entity: str, sep: str = ",") -> DataFrame:
    """(entity, feature, value) of a wide file whose first column is the entity."""
    wide = delimited(spark, path, sep=sep)
    first = wide.columns[0]
    features = [c for c in wide.columns if c != first]
    typed = wide.select(F.col(f"`{first}`").alias(entity), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in features])
    return melt(typed, [entity], features)


def gct(spark: SparkSession, path: str) -> DataFrame:
    """(feature, description, entity, value) of a GCT file: version and size lines, then a wide header.

    Lines keep their order by position in the file; the header is the only line that reaches the driver.
    """
    lines = spark.read.text(path)
    header = lines.where(F.lower(F.split("value", "\t")[0]) == "name").limit(1).collect()[0]["value"].split("\t")
    parts = F.split("value", "\t")
    body = lines.where((F.size(parts) == len(header)) & (F.lower(parts[0]) != "name"))
    cells = F.posexplode(F.slice(parts, 3, len(header) - 2)).alias("i", "x")
    long = body.select(parts[0].alias("feature"), parts[1].alias("description"), cells)
    names = F.array(*[F.lit(h) for h in header[2:]])
    return long.select("feature", "description", names[F.col("i")].alias("entity"), F.col("x").try_cast("double").alias("value")).where(F.col("value").isNotNull())


#: Processing methods in the order in which they are looked for, the pattern that names each in lower-case
#: text, and the scale of its values.
PROCESSING = (
    ("gcrma", r"\bgc[\s-]?rma\b", "log"),
    ("rma", r"\brma\b|robust\s+multi[\s-]?array", "log"),
    ("mas5", r"\bmas\s*5|\bgcos\b|microarray\s+suite\s*5|trimmed\s+mean.*target|global\s+scaling", "linear"),
    ("plier", r"\bplier\b", "log"),
    ("dchip", r"\bdchip\b|model[\s-]based\s+expression", "linear"),
    ("mas4", r"\bmas\s*4|average\s+difference", "linear"),
    ("vsn", r"\bvsn\b|variance\s+stabilis?z?ing", "log"),
    ("quantile", r"quantile\s+normal", "unknown"),
    ("lowess", r"\blowess\b|\bloess\b", "log"),
    ("rnaseq", r"\brsem\b|\btpm\b|\bfpkm\b|\brpkm\b|\bdeseq\b", "linear"),
)


def processing_family(text: Column) -> Column:
    """The method that a processing text names, "unknown" where it names none."""
    out = F.lit("unknown")
    for name, pattern, _ in reversed(PROCESSING):
        out = F.when(F.lower(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def processing_scale(text: Column) -> Column:
    """The scale of the method that a processing text names."""
    family, out = processing_family(text), F.lit("unknown")
    for name, _, scale in PROCESSING:
        out = F.when(family == name, F.lit(scale)).otherwise(out)
    return out


def harvested_method(text: Column) -> Column:
    """The short form of harvested metadata: five names, by words the text contains."""
    t = F.lower(text)
    return (
        F.when(t.contains("gcrma"), "gcRMA").when(t.rlike("rma|robust multi"), "RMA").when(t.rlike("mas5|mas 5|gcos"), "MAS5")
        .when(t.contains("quantile"), "quantile").otherwise("other")
    )


def species_guess(source_name: Column, characteristics: Column) -> Column:
    """A keyword guess at the species, for flagging only."""
    name, more = F.lower(source_name), F.lower(characteristics)
    either = lambda word, latin: F.coalesce(name.contains(word), F.lit(False)) | F.coalesce(more.contains(latin), F.lit(False))
    return (
        F.when(either("mouse", "mus musculus"), "possible_mouse").when(either("rat", "rattus"), "possible_rat")
        .when(either("human", "homo sapiens"), "looks_human").otherwise("unclear")
    )


def wide_subset(spark: SparkSession, path: str, entity: str, features: Sequence[str]) -> DataFrame:
    """The wanted feature columns of a wide parquet table that it has, read from its schema; the scan reads those alone."""
    df = spark.read.parquet(path)
    there = set(df.columns)
    return df.select(f"`{entity}`", *[f"`{f}`" for f in features if f in there])


def present(spark: SparkSession, folder: str, names: Sequence[str], required: bool = True) -> DataFrame:
    """(table_name, present) of the tables of a folder; an error where a ``required`` one is missing.

    Sources are only ever read; what is written goes to the checkpoint folder.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        rows.append((name, path.getFileSystem(conf).exists(path)))
    missing = [n for n, there in rows if not there]
    if required and missing:
        raise FileNotFoundError(f"no such tables in {folder}: {', '.join(missing)}")
    return spark.createDataFrame(rows, "table_name string, present boolean")


def fetched(spark: SparkSession, source: str, folder: str) -> str:
    """Path of a copy of ``source`` (any Hadoop file system) in the shared ``folder``, copied where it is not there yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    start = jvm.org.apache.hadoop.fs.Path(source)
    end = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{start.getName()}")
    target = end.getFileSystem(conf)
    if not target.exists(end):
        jvm.org.apache.hadoop.fs.FileUtil.copy(start.getFileSystem(conf), start, target, end, False, conf)
    return str(end.toString())


def harvest(wanted: DataFrame, key: str, landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of the ids of ``wanted``: what has been landed for them, and a row with the reason for the others.

    Nothing is fetched here: files are landed beforehand, since executors have no way out.
    """
    ids = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    records = ids.join(landed, key)
    failures = ids.join(landed.select(key).distinct(), key, "left_anti").select(key, F.lit("not landed").alias("reason"))
    return records, failures


def soft(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of a folder of SOFT sample files.

    Records have one row per sample (the first file by name wins) and a map ``fields`` of its
    ``!Sample_key = value`` lines, several values of a key joined by " | " in file order. Files
    without a sample id are failures.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("src_file"))
    found = F.regexp_extract_all("text", F.lit(r"(?m)^!Sample_[A-Za-z0-9_]+[ ]*=[^\r\n]*"), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^!Sample_([A-Za-z0-9_]+)", 1).alias("k"), F.trim(F.regexp_replace(x, r"^[^=]*=", "")).alias("v")))
    parsed = files.select("src_file", F.regexp_extract("text", r"(?m)\^SAMPLE[ ]*=[ ]*(\S+)", 1).alias("caret"), pairs.alias("pairs"))
    keys = F.array_distinct(F.transform("pairs", lambda p: p["k"]))
    fields = F.map_from_arrays(
        keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(F.col("pairs"), lambda p: p["k"] == k), lambda p: p["v"]), " | "))
    )
    shaped = parsed.select("src_file", "caret", fields.alias("fields"))
    sample = F.coalesce(F.col("fields")["geo_accession"], F.when(F.col("caret") != "", F.col("caret")))
    named = shaped.select("src_file", F.upper(sample).alias("gsm_id"), "fields", processing_family(F.col("fields")["data_processing"]).alias("proc_family"))
    records = first_of_each(named.where(F.col("gsm_id").isNotNull()), ["gsm_id"], [F.asc("src_file")])
    failures = named.where(F.col("gsm_id").isNull()).select("src_file", F.lit("no sample id").alias("reason"))
    return records, failures


def parameters(spark: SparkSession, path: str) -> dict:
    """A small JSON object of parameters, from any file system that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def hdf5(spark: SparkSession, path: str, dataset: str, rows: str, columns: str, rows_at_once: int = 1000) -> DataFrame:
    """(entity, feature, value) of an HDF5 matrix, a block of rows per task. Needs h5py on the executors."""
    if importlib.util.find_spec("h5py") is None:
        raise ImportError("reading HDF5 needs h5py")
    import h5py

    with h5py.File(path) as f:
        n = f[dataset].shape[0]

    def block(batches):  # noqa: ANN001, ANN202
        import h5py
        import pandas as pd

        for pdf in batches:
            for start in pdf["id"]:
                with h5py.File(path) as f:
                    ids = [x.decode() for x in f[rows][start : start + rows_at_once]]
                    names = [x.decode() for x in f[columns][:]]
                    part = pd.DataFrame(f[dataset][start : start + rows_at_once], index=ids, columns=names)
                yield part.rename_axis("entity").reset_index().melt("entity", var_name="feature", value_name="value").dropna()

    return spark.range(0, n, rows_at_once).mapInPandas(block, "entity string, feature string, value double")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under ``path``, hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, data_type, position) of the given tables."""
    rows = [(t, c, k, i) for t, df in tables.items() for i, (c, k) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")
