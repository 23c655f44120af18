"""Helpers shared by the training-data operators: shared-folder tables and native text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, \n, vertical tab, form feed, \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (tests, local runs) a scratch folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="scorebook-llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scorebook-llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without recomputing ``df``,
    and several consumers read one result.  The finished job's shuffle files are of no more
    use; a collection of the driver's garbage lets Spark's cleaner delete them now, not when the
    driver's heap happens to fill.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables that :func:`staged` wrote and nothing reads any more."""
    for df in tables:
        spark, home = df.sparkSession, f"{shared_dir(df.sparkSession)}/scorebook-llm/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            # only what lies in the shared folder is ours
            if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(home).toUri().getPath() + "/"):
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (also in inner lambdas)."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def word_count(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE_RUN))).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names near ``names`` that ``df`` does not have yet (extra columns may clash)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def has_bit(bitmap: Column, at: Column) -> Column:
    """Whether ``bitmap``, made by ``bitmap_construct_agg``, holds position ``at``; null without a bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1


def bit_words(bitmap: Column) -> Column:
    """A bitmap made by ``bitmap_construct_agg`` as 512 numbers: unlike a binary column, an array is not copied
    for each row that looks a bit up."""
    return F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(
        F.hex(F.substring(bitmap, i * 8 + 1, F.lit(8))), 16, -10).cast("long"))


def has_bit_in(words: Column, at: Column) -> Column:
    """Whether :func:`bit_words` hold position ``at``; null without any."""
    at = at.cast("int")
    word = F.get(words, F.shiftright(at, 6))
    return F.call_function("shiftright", word, at.bitwiseAND(63).bitwiseXOR(56)).bitwiseAND(1) == 1


def thinned(rows: DataFrame, key: str, ids: DataFrame, quick: bool = False) -> DataFrame:
    """``rows`` without most of those whose digest ``key`` is not in ``ids`` (one column of digests).

    A runtime filter before a join: one bit for each of 2 ** 26 digest slots, as at most 2,048
    bitmaps of 4 KB, so what is broadcast never exceeds 8 MB.  Rows whose slot is taken by
    another digest stay; the join sorts them out.  With very many ids it only filters less.
    ``quick``: the bitmaps as numbers, which pays if the rows are many.
    """
    id_col, = ids.columns
    bucket, bitmap = unused(rows, "slot_bucket", "slot_bitmap")

    def slot(digest: Column) -> Column:
        return F.shiftrightunsigned(digest, 38)
    bitmaps = ids.groupBy(F.bitmap_bucket_number(slot(F.col(id_col))).alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot(F.col(id_col)))).alias(bitmap))
    look_up = has_bit
    if quick:
        bitmaps, look_up = bitmaps.select(bucket, bit_words(F.col(bitmap)).alias(bitmap)), has_bit_in
    own = slot(F.col(key))
    joined = rows.join(F.broadcast(bitmaps), F.bitmap_bucket_number(own) == F.col(bucket))
    return joined.filter(look_up(F.col(bitmap), F.bitmap_bit_position(own))).select(*(F.col(f"`{c}`") for c in rows.columns))
