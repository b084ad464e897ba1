"""Metric samples ``(name, type, ts, value)``, health checks and structured logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import text as t
from lorespan.operators.skew import exact_quantiles, join_on

# Thresholds (warning, critical) in percent and the order of severity.
THRESHOLDS = {"CPU": (75.0, 90.0), "Memory": (80.0, 95.0), "Disk": (80.0, 95.0)}
SEVERITY = ("unknown", "healthy", "warning", "critical")


def counters(samples: DataFrame) -> DataFrame:
    return samples.where("type = 'counter'").groupBy("name").agg(F.sum("value").alias("value"))


def gauges(samples: DataFrame, tie: str = "ts") -> DataFrame:
    """The newest value of every gauge; ``tie`` orders samples of the same moment."""
    return samples.where("type = 'gauge'").groupBy("name").agg(F.max_by("value", F.struct("ts", tie)).alias("value"))


def histograms(samples: DataFrame, tie: str = "ts") -> DataFrame:
    return samples.where("type = 'histogram'").groupBy("name").agg(
        F.count("value").alias("count"), F.sum("value").alias("sum"), F.max_by("value", F.struct("ts", tie)).alias("last")
    )


def histogram_quantiles(samples: DataFrame, probabilities: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    names = [f"p{round(p * 100)}" for p in probabilities]
    return exact_quantiles(samples.where("type = 'histogram'"), ["name"], "value", probabilities, names)


def statistics(samples: DataFrame) -> DataFrame:
    """Metrics per type, counter total, mean gauge, number of observations."""
    is_ = lambda kind: F.col("type") == kind
    per = samples.groupBy("name", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max_by("value", "ts").alias("last")
    )
    return per.agg(
        F.count_if(is_("counter")).alias("counters"),
        F.count_if(is_("gauge")).alias("gauges"),
        F.count_if(is_("histogram")).alias("histograms"),
        F.count(F.lit(1)).alias("total_metrics"),
        F.coalesce(F.round(F.sum(F.when(is_("counter"), F.col("total"))), 4), F.lit(0.0)).alias("counter_total"),
        F.coalesce(F.round(F.avg(F.when(is_("gauge"), F.col("last"))), 2), F.lit(0.0)).alias("average_gauge"),
        F.coalesce(F.sum(F.when(is_("histogram"), F.col("n"))), F.lit(0)).alias("histogram_samples"),
    )


def search(samples: DataFrame, keyword: str, kind: str | None = None) -> DataFrame:
    """Metric names that contain the keyword, optionally of one type."""
    found = samples.where(t.contains_ci(F.col("name"), keyword))
    found = found if kind is None else found.where(F.col("type") == kind)
    return found.select("name", "type").distinct()


def exposition(samples: DataFrame, tie: str = "ts") -> DataFrame:
    """Text exposition lines with their order: ``# TYPE``, then the value or count and sum."""
    text = lambda c: F.format_string("%s", F.col(c))

    def lines(df: DataFrame, order: int, kind: str, values: list[Column]) -> DataFrame:
        head = F.concat(F.lit("# TYPE "), "name", F.lit(f" {kind}"))
        return df.select(F.lit(order).alias("section"), "name", F.posexplode(F.array(head, *values)).alias("n", "line"))

    single = [F.concat("name", F.lit(" "), text("value"))]
    pair = [F.concat("name", F.lit("_count "), text("count")), F.concat("name", F.lit("_sum "), text("sum"))]
    parts = [
        lines(counters(samples), 0, "counter", single),
        lines(gauges(samples, tie), 1, "gauge", single),
        lines(histograms(samples, tie), 2, "histogram", pair),
    ]
    return reduce(DataFrame.unionByName, parts)


# Health ----------------------------------------------------------------------------------------------------------


def check(samples: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Add ``status`` by the thresholds of the probe; probes without thresholds are unknown."""
    v = F.col(value)
    status = F.lit("unknown")
    for probe, (warning, critical) in THRESHOLDS.items():
        level = F.when(v >= critical, "critical").when(v >= warning, "warning").otherwise("healthy")
        status = F.when(F.col(name) == probe, level).otherwise(status)
    return samples.withColumn("status", status)


def overall_status(checks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The worst status with counts; unknown without checks."""
    rank = reduce(lambda acc, i: F.when(F.col("status") == SEVERITY[i], i).otherwise(acc), range(len(SEVERITY)), F.lit(0))
    worst = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.coalesce(F.max(rank), F.lit(0)) + 1)
    n = lambda s: F.count_if(F.col("status") == s)
    return checks.groupBy(*by).agg(
        worst.alias("overall_status"),
        F.count(F.lit(1)).alias("total_checks"),
        n("healthy").alias("healthy"),
        n("warning").alias("warnings"),
        n("critical").alias("critical"),
    )


# Logs ------------------------------------------------------------------------------------------------------------

LOG_SCHEMA = (
    "timestamp string, level string, message string, operation string, method string, path string, status int, "
    "latency_ms double, client_ip string, user_id string, model string, provider string, exception_type string, "
    "action string, actor string, resource string, _corrupt_record string"
)


def parse_logs(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON log lines as columns; a line that is no JSON object is kept in ``_corrupt_record``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return lines.withColumn("_r", F.from_json(line, LOG_SCHEMA, options)).select(
        *[c for c in lines.columns if c != line], "_r.*"
    )


def log_statistics(records: DataFrame) -> DataFrame:
    """Records of every kind and operation with their latency."""
    return records.where("_corrupt_record is null").groupBy("message", "operation").agg(
        F.count(F.lit(1)).alias("records"), F.round(F.avg("latency_ms"), 4).alias("average_latency")
    )


def request_latency(requests: DataFrame, path: str = "path", ms: str = "latency_ms") -> DataFrame:
    """Requests per path with mean, maximum and exact quantiles of the latency."""
    sums = requests.groupBy(path).agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.avg(ms), 4).alias("average"), F.max(ms).alias("slowest")
    )
    q = exact_quantiles(requests, [path], ms, [0.5, 0.95], ["p50", "p95"])
    return join_on(sums, q.select(path, F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95")), [path], "left")
