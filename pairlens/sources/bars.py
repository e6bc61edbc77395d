"""Sources and sinks: quotes, two-leg bars, macro series, CSV and Parquet stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import KEY, TS, drop_incomplete, forward_fill, nan_to_null
from ..operators.features import blockwise

BARS = T.StructType([T.StructField(KEY, T.StringType()), T.StructField(TS, T.TimestampType()), T.StructField("a_close", T.DoubleType()), T.StructField("b_close", T.DoubleType())])


def fixed(x: Column) -> Column:
    """Six decimals, by the same arithmetic in any engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bars(spark: SparkSession, path: str, schema: T.StructType = BARS, fmt: str = "parquet", since: str | None = None, until: str | None = None) -> DataFrame:
    """Bars from Parquet or CSV, NaN as NULL; since and until go to the scan."""
    df = spark.read.schema(schema).options(**({"header": "true"} if fmt == "csv" else {})).format(fmt).load(path)
    return nan_to_null(between(df, since, until))


def between(df: DataFrame, since: str | None = None, until: str | None = None, column: str = TS) -> DataFrame:
    for bound, sign in ((since, ">="), (until, "<")):
        if bound:
            df = df.where(F.expr(f"{column} {sign} timestamp'{bound}'"))
    return df


def read_first_available(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """The first of the paths that is there (most enriched first), NaN as NULL; FileNotFoundError if none is."""
    for p in paths:
        reader = spark.read.options(**({"header": "true"} if fmt == "csv" else {}))
        try:
            return nan_to_null((reader.schema(schema) if schema else reader).format(fmt).load(p))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {list(paths)}")


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = KEY, mode: str = "error") -> None:
    """A stage's output in a folder of its own; a stage never overwrites what it reads."""
    writer = df.write.mode(mode).options(**({"header": "true"} if fmt == "csv" else {})).format(fmt)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)


def quotes_to_bars(quotes: DataFrame, a: str, b: str, field: str = "close") -> DataFrame:
    """Long quotes (series_id, ts, ticker, field, value) to two-leg bars; rows without both legs go, NaN is NULL. The mean of equal keys counts."""
    wide = nan_to_null(quotes.where(F.col("field") == field)).groupBy(KEY, TS).pivot("ticker", [a, b]).agg(fixed(F.avg("value")))
    return drop_incomplete(wide.select(KEY, TS, F.col(a).alias("a_close"), F.col(b).alias("b_close")))


def bars_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean unit prices of two return flags, one series for each line status."""
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    quotes = li.select(
        F.col("l_linestatus").alias(KEY), F.col("l_shipdate").cast("timestamp").alias(TS), F.col("l_returnflag").alias("ticker"), F.lit("close").alias("field"), F.try_divide(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")).alias("value")
    )
    return quotes_to_bars(quotes, "A", "R")


def quotes_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order value of each priority, as the price of an instrument."""
    o = read_table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("timestamp").alias(TS)).agg(fixed(F.avg(F.col("o_totalprice").cast("double"))).alias("close"))


def pair_universe(quotes: DataFrame, buckets: int = 1) -> DataFrame:
    """Bars of each pair of instruments, a before b by name.

    A time with many instruments makes a crowd of pairs, so instruments are dealt into buckets, and each two buckets (and each with itself) at a time are a key of their own: a row
    goes to as many keys as there are buckets, and a key makes the pairs of two buckets only. One bucket is a plain self join on time.
    """
    own = F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int")
    item = F.struct("ticker", "close").alias("q")
    x = quotes.select(TS, item, own.alias("lo")).select("*", F.explode(F.sequence("lo", F.lit(buckets - 1))).alias("hi"))
    y = quotes.select(TS, item.alias("r"), own.alias("hi")).select("*", F.explode(F.sequence(F.lit(0), "hi")).alias("lo"))
    joined = x.join(y, [TS, "lo", "hi"]).where((F.col("lo") < F.col("hi")) & (F.col("q.ticker") != F.col("r.ticker")) | (F.col("lo") == F.col("hi")) & (F.col("q.ticker") < F.col("r.ticker")))
    first = F.col("q.ticker") < F.col("r.ticker")
    a, b = F.when(first, F.col("q")).otherwise(F.col("r")), F.when(first, F.col("r")).otherwise(F.col("q"))
    pairs = joined.select(TS, a.alias("a"), b.alias("b"))
    return pairs.select(F.concat_ws("/", "a.ticker", "b.ticker").alias(KEY), TS, F.col("a.close").alias("a_close"), F.col("b.close").alias("b_close"))


def filled_forward(df: DataFrame, columns: Sequence[str], limit: int = 3) -> DataFrame:
    """Each column's last value of the row and at most limit rows before it, in blocks: one long series is many tasks."""
    return blockwise(df, lambda rows, w: rows.withColumns({c: forward_fill(c, w, limit) for c in columns}), halo=limit)


def macro_merge(market: DataFrame, long_rate: DataFrame, short_rate: DataFrame, fill_limit: int = 3) -> DataFrame:
    """Rates joined fully on time and filled forward, then joined to the market's times; adds the slope of the curve."""
    rates = long_rate.join(short_rate, TS, "full").withColumn(KEY, F.lit("rates"))
    rates = filled_forward(rates, ["yield_long", "yield_short"], fill_limit).drop(KEY)
    out = market.join(rates, TS).withColumn("yield_curve_slope", F.col("yield_long") - F.col("yield_short"))
    return drop_incomplete(out.select(TS, "index", "yield_long", "yield_short", "yield_curve_slope"))


def macro_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three event types as hourly series: one as the market, two as sparse rates."""
    e = read_table(spark, sf_dir, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias(TS), "event_type", F.col("value").cast("double").alias("value"))
    hourly = lambda kind, name: e.where(F.col("event_type") == kind).groupBy(TS).agg(fixed(F.avg("value")).alias(name))
    return macro_merge(hourly("click", "index"), hourly("purchase", "yield_long"), hourly("signup", "yield_short"))
