"""Views of the given tables as genomic entities, in Spark and in the SQL that oracles share."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(spark: SparkSession, sf_dir: str, name: str, columns: str) -> DataFrame:
    """The columns of an adapter, written once for both engines."""
    return table(spark, sf_dir, name).selectExpr(*[c.strip() for c in columns.strip().split(";\n")])


#: Signatures from lineitem.
SIGS = """
concat('chr', CAST(l_suppkey % 22 + 1 AS STRING)) AS chrom;
CASE WHEN l_linestatus = 'F' THEN 'DEL' ELSE 'INS' END AS svtype;
CAST(l_orderkey * 100 + CAST(l_quantity AS BIGINT) AS BIGINT) AS pos;
CAST(30 + (l_partkey * 37) % 1500 AS BIGINT) AS svlen;
l_partkey AS rname;
CAST(20 + l_linenumber * 6 AS INT) AS mapq;
l_returnflag AS flag;
CAST(l_linenumber AS INT) AS ln;
l_orderkey AS okey
"""

#: Regions from orders.
REGIONS = """
concat('chr', CAST(o_custkey % 22 + 1 AS STRING)) AS chrom;
o_orderkey * 100 AS start;
o_orderkey * 100 + 5000 + o_custkey % 20000 AS end;
o_orderkey AS rid
"""

#: Alignment segments from lineitem: the lines of an order are the segments of a read.
SEGMENTS = """
l_orderkey AS qname;
CAST(l_linenumber AS INT) AS ln;
l_partkey AS tie1;
l_suppkey AS tie2;
l_extendedprice AS tie3;
concat('chr', CAST(l_suppkey % 3 + 1 AS STRING)) AS chrom;
l_partkey * 50 AS ref_start;
l_partkey * 50 + 200 + l_suppkey % 400 AS ref_end;
CASE WHEN l_returnflag = 'N' THEN '-' ELSE '+' END AS strand;
CAST(20 + l_linenumber * 6 AS INT) AS mapq;
CAST(l_linenumber * 600 + l_partkey % 97 AS BIGINT) AS q_start;
CAST(l_linenumber * 600 + l_partkey % 97 + 200 + l_suppkey % 400 AS BIGINT) AS q_end
"""

#: Points from events; event types stand for callers.
POINTS = """
event_id;
concat('chr', CAST(user_id % 22 + 1 AS STRING)) AS chrom;
user_id;
event_type AS tool;
value
"""


def sigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, "lineitem", SIGS)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, "orders", REGIONS)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, "lineitem", SEGMENTS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long")
    rows = table(spark, sf_dir, "events").withColumn("pos", seconds)
    return rows.selectExpr("pos", *[c.strip() for c in POINTS.strip().split(";\n")])


#: What a letter becomes, and all bytes that go.
BASES = bytes.maketrans(string.ascii_lowercase.encode(), ("ACGT" * 7)[:26].encode())
OTHERS = bytes(b for b in range(256) if chr(b) not in string.ascii_lowercase)


@F.pandas_udf(T.StringType())
def _bases(text: pd.Series) -> pd.Series:
    return pd.Series(["" if t is None else t.lower().encode().translate(BASES, OTHERS).decode() for t in text], dtype=object)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of documents recoded to bases: (sid, seq)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), _bases("text").alias("seq"))


def _sql(columns: str, source: str) -> str:
    text = columns.strip().replace(";\n", ",\n").replace("AS STRING", "AS VARCHAR").replace(" AS end", ' AS "end"')
    return f"SELECT {text} FROM {source}"


#: Common table expressions for the oracles.
VIEWS = {
    "sigs": _sql(SIGS, "lineitem"),
    "regions": _sql(REGIONS, "orders"),
    "segments": _sql(SEGMENTS, "lineitem"),
    "points": f"SELECT epoch_us(ts) // 1000000 AS pos, {POINTS.strip().replace(';' + chr(10), ',' + chr(10)).replace('AS STRING', 'AS VARCHAR')} FROM events",
    "seqs": """SELECT doc_id AS sid, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'),
               'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents""",
}


def sql(body: str, *views: str) -> str:
    """``body`` behind the common table expressions it needs; further ones may start with a comma."""
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    body = body.strip()
    if not head:
        return body
    return f"WITH {head} {body}" if body.startswith(",") or not body.upper().startswith("WITH") else f"WITH {head}, {body[4:]}"
