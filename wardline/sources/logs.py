"""Log sources: access-log lines and structured JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.schemas import LOG_LINE

# ---- Fixed values: the proxy's log format ---------------------------------------------------------
# $remote_addr - $remote_user [$time_local] "$request" $status $body_bytes_sent "$http_referer"
# "$http_user_agent" "$http_x_forwarded_for" rt=$request_time uct="$upstream_connect_time"
# uht="$upstream_header_time" urt="$upstream_response_time"
ACCESS_LINE = (
    r'^(\S+) - (\S+) \[([^\]]*)\] "([^"]*)" ([0-9]{3}) ([0-9]+) "[^"]*" "[^"]*" "[^"]*" '
    r'rt=([0-9.]+) uct="[^"]*" uht="[^"]*" urt="([^"]*)"$'
)
ACCESS_TIME = "dd/MMM/yyyy:HH:mm:ss Z"
# ---- End of fixed values --------------------------------------------------------------------------


def parse_access_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Access-log lines as columns. A line of another form, or with a time or number that cannot be
    read, keeps its text in ``malformed``.

    One pattern pass splits the line; the fields are then taken from the pieces.
    """
    sep = "\x1f"
    pieces = F.split(F.regexp_replace(line, ACCESS_LINE, sep.join(f"${i}" for i in range(1, 9))), sep)
    ok = F.size("_p") == 8

    def field(i: int) -> Column:
        return F.when(ok, F.get("_p", F.lit(i)))

    read = lines.withColumn("_p", pieces).withColumns({
        "_ts": F.try_to_timestamp(field(2), F.lit(ACCESS_TIME)), "_status": field(4).try_cast("int"),
        "_bytes": field(5).try_cast("long"), "_time": field(6).try_cast("double")})
    broken = ~ok | F.greatest(*[F.col(c).isNull() for c in ("_ts", "_status", "_bytes", "_time")])
    return read.select(
        field(0).alias("ip"), field(1).alias("remote_user"), F.col("_ts").alias("ts"),
        field(3).alias("request"), F.col("_status").alias("status"), F.col("_bytes").alias("bytes"),
        F.col("_time").alias("request_time"), field(7).try_cast("double").alias("upstream_time"),
        F.when(broken, F.col(line)).alias("malformed"))


def access_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_access_log(spark.read.text(path))


def structured_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line with the fixed fields; other fields are ignored."""
    return spark.read.schema(LOG_LINE).json(path)
