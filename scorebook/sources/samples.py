"""Labelled sample sources.

A sample is one row ``(sample_id, image_path, label[, content])``.  Images are read
with the ``binaryFile`` source; ``content`` is read only if selected (column pruning
makes the image bytes lazy).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorebook.operators.ranges import row_index

DEFAULT_EXTENSIONS = (".png", ".jpg", ".jpeg")


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _is_one_below(spark: SparkSession, root: str) -> Column:
    """Is the file exactly one directory below the root?  Counts parts behind scheme and host."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    depth = len(re.sub(_SCHEME, "", str(fs.makeQualified(p).toString())).rstrip("/").split("/"))
    return F.size(F.split(F.regexp_replace("path", _SCHEME, ""), "/")) == depth + 2


def extension_of(path: Column) -> Column:
    """Lower-cased file suffix including the dot ('' when there is none)."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def label_for_directory(dir_name: Column, labels: Sequence[str],
                        label_map: dict[str, str] | None = None) -> Column:
    """Exact ``label_map`` entry first, else a case-insensitive label match, else null."""
    exact = None
    for k, v in (label_map or {}).items():
        exact = F.when(dir_name == k, F.lit(v)) if exact is None else exact.when(dir_name == k, F.lit(v))
    loose = None
    for x in labels:
        c = F.lower(dir_name) == x.lower()
        loose = F.when(c, F.lit(x)) if loose is None else loose.when(c, F.lit(x))
    return F.coalesce(*(e for e in (exact, loose) if e is not None))


def load_samples_from_directory(spark: SparkSession, root: str, labels: Sequence[str],
                                label_map: dict[str, str] | None = None,
                                extensions: Sequence[str] = DEFAULT_EXTENSIONS,
                                with_content: bool = False,
                                id_from: str = "dir_stem") -> DataFrame:
    """One class per sub-directory, files exactly one level deep.

    ``id_from='dir_stem'`` (default) makes ids unique across classes (``dir/stem``);
    ``'stem'`` keeps the bare file stem, which can repeat between class folders."""
    if not _path_exists(spark, root):
        raise FileNotFoundError(f"sample root not found: {root}")
    df = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*")
    parts = F.split(F.col("path"), "/")
    # a directory matched by the pattern is listed too: its files are one level too deep
    df = df.filter(_is_one_below(spark, root))
    dir_name = F.element_at(parts, -2)
    file_name = F.element_at(parts, -1)
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    out = (df.filter(extension_of(F.col("path")).isin([e.lower() for e in extensions]))
             .select(F.col("path").alias("image_path"), dir_name.alias("_dir"),
                     stem.alias("_stem"), *(["content"] if with_content else [])))
    out = out.withColumn("label", label_for_directory(F.col("_dir"), labels, label_map)) \
             .filter(F.col("label").isNotNull())
    sid = F.concat_ws("/", "_dir", "_stem") if id_from == "dir_stem" else F.col("_stem")
    return out.select(sid.alias("sample_id"), "image_path", "label",
                      *(["content"] if with_content else []))


def load_samples_from_csv(spark: SparkSession, path: str, image_col: str = "image_path",
                          label_col: str = "label", id_col: str | None = "sample_id",
                          id_fallback: str = "hash") -> DataFrame:
    """Manifest CSV with renameable columns, all read as strings (no inference).

    Without an id column the id is ``xxhash64(image_path)`` (``id_fallback='hash'``) or
    the 0-based row position (``'row_index'``, requires an ordered scan)."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    cols = raw.columns
    if image_col not in cols or label_col not in cols:
        raise ValueError(f"manifest needs columns {image_col!r} and {label_col!r}; got {cols}")
    df = raw.select(F.col(image_col).alias("image_path"), F.col(label_col).alias("label"),
                    *([F.col(id_col).alias("sample_id")] if id_col and id_col in cols else []))
    if "sample_id" in df.columns:
        return df.select("sample_id", "image_path", "label")
    if id_fallback == "row_index":
        return row_index(df, "sample_id").select(F.col("sample_id").cast("string").alias("sample_id"),
                                                 "image_path", "label")
    return df.select(F.xxhash64("image_path").cast("string").alias("sample_id"),
                     "image_path", "label")


def check_labels(samples: DataFrame, labels: Sequence[str], label_col: str = "label",
                 raise_on_invalid: bool = True) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, quarantined) rows; optionally fail on any invalid label."""
    ok = F.col(label_col).isin(list(labels))
    bad = samples.filter(~F.coalesce(ok, F.lit(False)))
    if raise_on_invalid:
        sample = bad.limit(5).collect()
        if sample:
            raise ValueError(f"labels outside {list(labels)}: {[r[label_col] for r in sample]}")
    return samples.filter(F.coalesce(ok, F.lit(False))), bad


def dropped_directories(spark: SparkSession, root: str, labels: Sequence[str],
                        label_map: dict[str, str] | None = None) -> DataFrame:
    """Class directories that no label stands for, with their number of files."""
    parts = F.split(F.col("path"), "/")
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*").select("path") \
        .filter(_is_one_below(spark, root))
    return files.select(F.element_at(parts, -2).alias("directory")) \
        .filter(label_for_directory(F.col("directory"), labels, label_map).isNull()) \
        .groupBy("directory").agg(F.count(F.lit(1)).alias("n_files"))


def first_n(samples: DataFrame, n: int, order_cols: Sequence[str] = ("image_path",)) -> DataFrame:
    """P4 (compat): the first n samples in path order (may take a single class)."""
    return samples.orderBy(*order_cols).limit(n)


def balanced_total(samples: DataFrame, total: int, label_col: str = "label",
                   id_col: str = "sample_id") -> DataFrame:
    """Exactly ``total`` samples (all, if there are fewer), as even over labels as they
    allow: the first of every label in ``stratified_n``'s order, then the second ..."""
    picked = stratified_n(samples, total, label_col, id_col)
    turn = F.row_number().over(Window.partitionBy(label_col).orderBy(F.md5(F.col(id_col).cast("string")), id_col))
    return picked.withColumn("_turn", turn).orderBy("_turn", label_col).limit(total).drop("_turn")


def stratified_n(samples: DataFrame, n_per_label: int, label_col: str = "label",
                 id_col: str = "sample_id", oversample: float = 2.0) -> DataFrame:
    """P4 (default): the n samples per label with the smallest ``md5(id)`` (a stable,
    seed-free pseudo-random order); exact, and no window ever holds a whole label.

    1. rows per label (one small aggregation, collected: one row per label);
    2. keep rows whose md5-derived uniform value is below a per-label threshold chosen
       to leave about ``oversample x n`` candidates; ordering by that value agrees with
       ordering by the md5 text, so no true member is cut;
    3. rank only the candidates.  A label that ends up with fewer than n candidates
       (and is not exhausted) gets a wider threshold and is redone."""
    h = F.md5(F.col(id_col).cast("string"))
    u = F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2 ** 52))
    staged = samples.withColumn("_h", h).withColumn("_u", u)
    counts = {r[0]: r[1] for r in samples.groupBy(label_col).count().collect()}
    factor = {lab: oversample for lab in counts}
    while True:
        thresholds = {lab: min(1.0, factor[lab] * n_per_label / max(c, 1) + 1e-9)
                      for lab, c in counts.items()}
        cond = None
        for lab, t in thresholds.items():
            c = (F.col(label_col).eqNullSafe(F.lit(lab))) & (F.col("_u") <= F.lit(t))
            cond = c if cond is None else cond | c
        cand = staged.filter(cond) if cond is not None else staged.limit(0)
        got = {r[0]: r[1] for r in cand.groupBy(label_col).count().collect()}
        short = [lab for lab, t in thresholds.items()
                 if t < 1.0 and got.get(lab, 0) < min(n_per_label, counts[lab])]
        if not short:
            break
        for lab in short:
            factor[lab] *= 4
    w = Window.partitionBy(label_col).orderBy("_h", id_col)
    return (cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_per_label)
                .drop("_h", "_u", "_r"))
