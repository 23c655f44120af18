"""S3-S6, U1-U4, X2 (batch): results tables in and out.

The results table has a fixed schema (read with it, never inferred); the older
10-column form is widened with nulls.  Writes are partitioned by condition, with
dynamic partition overwrite so re-running one condition replaces only its files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.operators.ranges import row_index

RESULTS_FIELDS = [
    ("sample_id", T.StringType()), ("image_path", T.StringType()),
    ("true_label", T.StringType()), ("predicted_label", T.StringType()),
    ("raw_output", T.StringType()), ("parse_success", T.BooleanType()),
    ("model_name", T.StringType()), ("model_id", T.StringType()),
    ("backend", T.StringType()), ("prompt_id", T.StringType()),
    ("inference_time_s", T.DoubleType()), ("input_tokens", T.LongType()),
    ("output_tokens", T.LongType()), ("cost_usd", T.DoubleType()),
    ("error", T.StringType()),
]
LEGACY_FIELDS = ["sample_id", "image_path", "true_label", "predicted_label", "raw_output",
                 "parse_success", "model_name", "prompt_id", "inference_time_s", "error"]


def results_schema(labels: Sequence[str] = ()) -> T.StructType:
    fields = [T.StructField(n, t, True) for n, t in RESULTS_FIELDS]
    fields += [T.StructField(f"prob_{x}", T.DoubleType(), True) for x in labels]
    return T.StructType(fields)


def read_results_csv(spark: SparkSession, path: str, labels: Sequence[str] = (),
                     na_strings: Sequence[str] = ()) -> DataFrame:
    """S3: CSV with multi-line quoted text and doubled quotes, explicit schema.

    Only an empty field is null; ``na_strings`` (e.g. ``["None", "null"]``) adds more
    null spellings for string columns."""
    present = spark.read.option("header", True).csv(path).columns
    full = results_schema(labels)
    schema = T.StructType([f for f in full.fields if f.name in present]
                          + [T.StructField(c, T.StringType(), True) for c in present
                             if c not in full.fieldNames()])
    order = {c: i for i, c in enumerate(present)}
    schema = T.StructType(sorted(schema.fields, key=lambda f: order[f.name]))
    # tables written elsewhere may hold whole numbers as 512.0 where a column has gaps
    longs = [f.name for f in schema.fields if isinstance(f.dataType, T.LongType)]
    as_read = T.StructType([T.StructField(f.name, T.DoubleType(), True) if f.name in longs else f
                            for f in schema.fields])
    df = (spark.read.schema(as_read).option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path))
    df = df.withColumns({c: F.col(c).cast("long") for c in longs})
    for c in [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]:
        if na_strings:
            df = df.withColumn(c, F.when(F.col(c).isin(list(na_strings)), None).otherwise(F.col(c)))
    return df


def widen_legacy(df: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """Bring an older/narrower results table to the full schema (missing -> null)."""
    full = results_schema(labels)
    cols = []
    for f in full.fields:
        cols.append(F.col(f.name).cast(f.dataType) if f.name in df.columns
                    else F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in full.fieldNames()]
    return df.select(*cols, *extra)


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Concatenate runs by column name, missing columns null, duplicates kept."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def dedupe_results(df: DataFrame, key: Sequence[str] = ("sample_id", "model_name", "prompt_id"),
                   order_by: Sequence[str] = ()) -> DataFrame:
    """X2 (batch): one row per (sample, condition) when a run was appended twice.

    The copy with the largest ``order_by`` values stays (e.g. an arrival time: the latest);
    copies equal there are ordered by their other columns, so reruns agree.  Rows are dealt by their
    key first: copies come from different runs, so a combine before the shuffle finds none and
    sorts every row for it.  One aggregation that streams; no window holds the copies of a key."""
    rest = [c for c in df.columns if c not in key]
    ranked = [*order_by, *[c for c in rest if c not in order_by]]
    sortable = [c for c in ranked if not isinstance(df.schema[c].dataType, T.MapType)]
    if not rest:
        return df.dropDuplicates(list(key))
    if set(rest) <= set(sortable):      # the order holds every column: it is carried once
        best = F.max(F.struct(*dict.fromkeys(ranked)))
    else:
        best = F.max_by(F.struct(*rest), F.struct(*sortable)) if sortable else F.first(F.struct(*rest))
    return df.repartition(*key).groupBy(*key).agg(best.alias("_best")).select(
        *[F.col(c) if c in key else F.col(f"_best.{c}").alias(c) for c in df.columns])


def shared_ids(df: DataFrame, cond_a: dict, cond_b: dict, id_col: str = "sample_id") -> DataFrame:
    """Sample ids evaluated under both conditions."""
    def ids(cond):
        f = None
        for k, v in cond.items():
            f = (F.col(k) == v) if f is None else f & (F.col(k) == v)
        return df.filter(f).select(id_col)
    return ids(cond_a).intersect(ids(cond_b))


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Wanted columns absent from ``df`` (driver-side schema check)."""
    return [c for c in wanted if c not in df.columns]


def present_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Wanted columns that exist, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def write_results(df: DataFrame, path: str,
                  partition_cols: Sequence[str] = ("model_name", "prompt_id"),
                  fmt: str = "parquet") -> None:
    """Partitioned by condition; re-writing a condition replaces only its
    partition (dynamic overwrite), other conditions already on disk are kept."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols).format(fmt).save(path))


def write_report_csv(df: DataFrame, path: str) -> None:
    """One CSV with header for a condition-sized report table."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def ensure_sample_id(df: DataFrame, id_col: str = "sample_id", mode: str = "require") -> DataFrame:
    """The analysis pairs conditions by sample id.

    ``require`` (default) fails when the column is missing.  ``row_index`` numbers
    the rows 0.. over the whole table (the older behaviour, which makes every id
    unique across conditions, so no pairs exist for McNemar)."""
    if id_col in df.columns:
        return df
    if mode == "require":
        raise ValueError(f"results have no {id_col!r} column; pairing needs it")
    if mode != "row_index":
        raise ValueError("mode must be 'require' or 'row_index'")
    return row_index(df, id_col).withColumn(id_col, F.col(id_col).cast("string"))
