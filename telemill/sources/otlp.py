"""OTLP/JSON export files as flat rows: resource, scope and record levels unnested, attributes as maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANY = "struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double,arrayValue:struct<values:array<struct<stringValue:string>>>,kvlistValue:string,bytesValue:string>"
KEYS = f"array<struct<key:string,value:{ANY}>>"
_SCOPE = "scope:struct<name:string,version:string>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{KEYS},status:struct<code:int,message:string>>"
_LOG = f"struct<timeUnixNano:string,severityNumber:int,severityText:string,eventName:string,body:struct<stringValue:string>,traceId:string,spanId:string,attributes:{KEYS}>"
_POINT = f"struct<timeUnixNano:string,attributes:{KEYS},asInt:string,asDouble:double>"
_HIST = f"struct<timeUnixNano:string,attributes:{KEYS},count:string,sum:double,min:double,max:double,bucketCounts:array<string>,explicitBounds:array<double>>"
_METRIC = (
    f"struct<name:string,unit:string,sum:struct<aggregationTemporality:int,isMonotonic:boolean,dataPoints:array<{_POINT}>>,"
    f"gauge:struct<dataPoints:array<{_POINT}>>,histogram:struct<aggregationTemporality:int,dataPoints:array<{_HIST}>>>"
)
# signal: names of the two outer lists, the record list, the record's type
SIGNALS = {
    "traces": ("resourceSpans", "scopeSpans", "spans", _SPAN),
    "logs": ("resourceLogs", "scopeLogs", "logRecords", _LOG),
    "metrics": ("resourceMetrics", "scopeMetrics", "metrics", _METRIC),
}
#: An attribute value: one of its fields is set.
VALUE = "struct<s:string,i:bigint,b:boolean,d:double,a:array<string>>"
MOST_ATTRIBUTES, LONGEST_KEY, LONGEST_VALUE = 64, 128, 4096


def schema(signal: str) -> str:
    outer, inner, records, record = SIGNALS[signal]
    return f"{outer} array<struct<resource:struct<attributes:{KEYS}>,{inner}:array<struct<{_SCOPE},{records}:array<{record}>>>>>"


def read(spark: SparkSession, signal: str, path: str, stream: bool = False) -> DataFrame:
    """Records of export files (one request a line): resource (key list), scope_name, scope_version, record."""
    reader = (spark.readStream if stream else spark.read).schema(schema(signal))
    return unnested(reader.json(path), signal)


def unnested(requests: DataFrame, signal: str) -> DataFrame:
    outer, inner, records, _ = SIGNALS[signal]
    r = requests.select(F.explode(outer).alias("r"))
    s = r.select(F.col("r.resource.attributes").alias("resource"), F.explode(f"r.{inner}").alias("s"))
    return s.select("resource", F.col("s.scope.name").alias("scope_name"), F.col("s.scope.version").alias("scope_version"), F.explode(f"s.{records}").alias("record"))


def attributes(pairs: Column) -> Column:
    """A key list as a map of typed values; maps, bytes, mixed lists, long keys and long values are left out."""
    v = lambda kv: kv["value"]
    texts = lambda kv: F.transform(v(kv)["arrayValue"]["values"], lambda x: x["stringValue"])
    short = lambda kv: (
        (F.length(kv["key"]) <= LONGEST_KEY) & v(kv)["kvlistValue"].isNull() & v(kv)["bytesValue"].isNull() & (F.coalesce(F.length(v(kv)["stringValue"]), F.lit(0)) <= LONGEST_VALUE)
        & F.coalesce(F.forall(texts(kv), lambda t: t.isNotNull() & (F.length(t) <= LONGEST_VALUE)), F.lit(True))
    )
    typed = lambda kv: F.struct(
        kv["key"].alias("key"),
        F.struct(v(kv)["stringValue"].alias("s"), v(kv)["intValue"].try_cast("long").alias("i"), v(kv)["boolValue"].alias("b"), v(kv)["doubleValue"].alias("d"), texts(kv).alias("a")).alias("value"),
    )
    kept = F.transform(F.filter(F.coalesce(pairs, F.array().cast(KEYS)), short), typed)
    # of a key given twice the last value holds
    last = F.filter(kept, lambda e, i: F.array_position(F.transform(F.slice(kept, i + 2, F.size(kept)), lambda x: x["key"]), e["key"]) == 0)
    return F.map_from_entries(last)


def too_many(pairs: Column) -> Column:
    return F.coalesce(F.size(pairs), F.lit(0)) > MOST_ATTRIBUTES


def merged(resource: Column, record: Column) -> Column:
    """Both levels' attributes; the record's win."""
    own = F.map_keys(record)
    return F.map_concat(F.map_filter(resource, lambda k, _: ~F.array_contains(own, k)), record)


def nanos(text: Column) -> Column:
    """A nanosecond count as a timestamp of microseconds."""
    return F.timestamp_micros((text.try_cast("decimal(38,0)") / 1000).cast("long"))
