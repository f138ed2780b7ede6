"""Results as files for other readers: partitioned by the month of a business date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.functions.columns import month_code

ROWS_PER_FILE = 5_000_000
NO_MONTH = "none"


def write_by_month(rows: DataFrame, path: str, date: str, *, month: str = "month", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes rows to a folder for each month of `date` (`yyyyMM`, or `none` without a date); replaces these months only.

    A rerun of some months leaves all others as they are. Rows of one month are dealt out in proportion to their number,
    so no task and no file has many more than `rows_per_file`, also where one month holds most of them; a file never
    has more. Months are counted first, which reads the rows twice: store what is costly to compute.
    """
    dated = rows.withColumn(month, F.coalesce(month_code(date), F.lit(NO_MONTH)))
    sizes = dated.groupBy(month).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files"))
    place = F.pmod(F.xxhash64(*rows.columns), F.col("_files")).cast("int")  # the same when a task is run again
    dealt = dated.join(F.broadcast(sizes), month).withColumn("_file", place)  # sizes have a row a month
    dealt = dealt.repartition(month, "_file").drop("_files", "_file")
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy(month).parquet(path)
