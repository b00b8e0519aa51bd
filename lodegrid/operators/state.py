"""State that only grows: event logs, resumable work, and tables that are replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the register of decisions.
REGISTER = ("timestamp", "phase", "kind", "subject", "decision", "rationale", "actor")
REGISTER_SCHEMA = ", ".join(f"{c} string" for c in REGISTER)


def events(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Rows as events of the register; columns that aren't given are empty."""
    return df.select(*[(F.lit(columns.get(c, "")) if isinstance(columns.get(c, ""), str) else columns[c]).cast("string").alias(c) for c in REGISTER])


def append(df: DataFrame, path: str) -> None:
    df.select(*REGISTER).write.mode("append").parquet(path)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTER_SCHEMA).parquet(path)


def append_once(df: DataFrame, path: str) -> bool:
    """Append unless the register has events of the same phase and kind; True if it appended.

    One writer at a time: the check and the append are two steps, so two writers at once may both find nothing and both append.
    """
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        df = df.join(read_register(spark, path).select("phase", "kind").distinct(), ["phase", "kind"], "left_anti")
    if df.isEmpty():
        return False
    append(df, path)
    return True


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't done yet."""
    return work.join(done.select(key), key, "left_anti")


def upserted(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those of their key column by column where they aren't null; new keys are added."""
    a = state.select(*[F.col(c).alias(f"a_{c}") for c in state.columns])
    b = changes.select(*[F.col(c).alias(f"b_{c}") for c in changes.columns])
    out = a.join(b, F.col(f"a_{key}") == F.col(f"b_{key}"), "full_outer")
    return out.select(*[(F.coalesce(f"b_{c}", f"a_{c}") if c in changes.columns else F.col(f"a_{c}")).alias(c) for c in state.columns])


def without_last(state: DataFrame, order: str) -> DataFrame:
    """All rows but the one with the highest order: undo."""
    last = state.agg(F.max(order).alias("__last"))
    return state.crossJoin(F.broadcast(last)).filter(F.col(order) < F.col("__last")).drop("__last")


def replaced(df: DataFrame, path: str) -> None:
    """Write next to the path, then rename: nobody sees a half-written table. One writer at a time, and a reader that comes between
    the two renames finds no table and has to try again; on object stores a rename copies."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, fresh, old = hadoop.Path(path), hadoop.Path(f"{path}.new"), hadoop.Path(f"{path}.old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(fresh.toString())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def dropped(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def overdue(status: DataFrame, today: str, days: int = 14, state: str = "state", since: str = "first_attempt") -> DataFrame:
    """Failed or pending for so many days."""
    waited = F.datediff(F.lit(today).cast("date"), F.substring(F.col(since), 1, 10).try_cast("date"))
    return status.filter(F.col(state).isin("failed", "pending") & (waited >= days))


def changed(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """key, was, now of values that are new and not blank."""
    was = before.select(key, F.col(column).alias("was"))
    return after.select(key, F.col(column).alias("now")).join(was, key).filter("now != was and now != ''").select(key, "was", "now")


def migrated(df: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema in its order: missing ones are null, others go."""
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields])


def forced_exclusions(df: DataFrame, decision: str = "decision", criterion: str = "criterion", rationale: str = "rationale", default: str = "EC4", prefix: str = "[forced exclude] ") -> DataFrame:
    """Deferred rows are excluded by a default criterion, and say so."""
    deferred = F.col(decision) == "defer"
    return df.withColumns({
        criterion: F.when(deferred, F.coalesce(F.nullif(F.col(criterion), F.lit("")), F.lit(default))).otherwise(F.col(criterion)),
        rationale: F.when(deferred, F.concat(F.lit(prefix), F.coalesce(rationale, F.lit("")))).otherwise(F.col(rationale)),
        decision: F.when(deferred, "exclude").otherwise(F.col(decision)),
    })
