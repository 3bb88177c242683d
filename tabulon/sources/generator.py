"""Synthetic transactions with known totals, made by Spark from row numbers and a seed."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the generated table.
COUNTRIES = ("SK", "CZ", "DE", "AT", "PL", "HU")
USERS = 50_000
MAX_CENTS = 2_000_000
FIRST_SECOND = 1_704_067_200  # 2024-01-01
SECONDS = 1096 * 86_400  # to the end of 2026
DEFAULT_SEED = 20_260_101
COLUMNS = ("transaction_id", "user_id", "amount", "country", "timestamp")


@dataclass
class Totals:
    """What the written rows add up to; corrupted ones are left out of all but their own count."""

    rows: int
    corrupted: int
    total_amount: Decimal
    rows_in_2025: int
    minimum: Decimal
    maximum: Decimal
    countries: int
    null_countries: int


def _draw(seed: int, what: int) -> Column:
    """An even number from 0 to 2**62 for each row."""
    return F.xxhash64(F.col("id"), F.lit(seed), F.lit(what)).bitwiseAND(F.lit((1 << 62) - 1))


def transactions(spark: SparkSession, rows: int, seed: int = DEFAULT_SEED, corrupt: float = 0.0, null: float = 0.01, partitions: int | None = None) -> DataFrame:
    """The table as it will be written, with ``corrupted``."""
    share = lambda what: _draw(seed, what) / float(1 << 62)
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), (_draw(seed, 3) % len(COUNTRIES) + 1).cast("int"))
    base = spark.range(1, rows + 1, 1, partitions) if partitions else spark.range(1, rows + 1)
    return base.select(
        F.col("id").alias("transaction_id"), (_draw(seed, 1) % USERS + 1).alias("user_id"), ((_draw(seed, 2) % MAX_CENTS + 1) / F.lit(100).cast("decimal(5,0)")).cast("decimal(18,2)").alias("amount"),
        F.when(share(4) >= null, country).alias("country"), F.timestamp_seconds(_draw(seed, 5) % SECONDS + FIRST_SECOND).cast("timestamp_ntz").alias("timestamp"), (share(6) < corrupt).alias("corrupted"),
    )


def totals(table: DataFrame) -> Totals:
    good = ~F.col("corrupted")
    row = table.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("corrupted").alias("bad"), F.sum(F.when(good, F.col("amount"))).alias("sum"), F.count_if(good & (F.year("timestamp") == 2025)).alias("y"),
        F.min(F.when(good, F.col("amount"))).alias("lo"), F.max(F.when(good, F.col("amount"))).alias("hi"), F.count_distinct(F.when(good, F.col("country"))).alias("c"), F.count_if(good & F.col("country").isNull()).alias("nc"),
    ).first()
    return Totals(row.n, row.bad, row["sum"] or Decimal(0), row.y, row.lo, row.hi, row.c, row.nc)


def generate(spark: SparkSession, path: str, rows: int, seed: int = DEFAULT_SEED, header: bool = True, corrupt: float = 0.0, null: float = 0.01, delimiter: str = ",", decimal_separator: str = ".", partitions: int = 1) -> Totals:
    """Write the table as delimited text (corrupted rows end after the amount) and return its totals."""
    table = transactions(spark, rows, seed, corrupt, null, partitions)
    amount = F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(decimal_separator))
    rest = F.array(F.coalesce("country", F.lit("")), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    start = F.array(F.col("transaction_id").cast("string"), F.col("user_id").cast("string"), amount)
    line = F.concat_ws(delimiter, F.when(F.col("corrupted"), start).otherwise(F.concat(start, rest)))
    lines = table.select(line.alias("value"))
    if header:
        # Each file begins with the labels: its first row is the least of a range of row numbers.
        starts = [rows * k // partitions + 1 for k in range(partitions)]
        label = F.lit(delimiter.join(COLUMNS) + "\n")
        lines = table.select(F.when(F.col("transaction_id").isin(starts), F.concat(label, line)).otherwise(line).alias("value"))
    lines.write.mode("overwrite").text(path)
    return totals(table)
