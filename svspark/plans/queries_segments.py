"""Queries of the alignment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as S
from . import adapters as A
from . import query
from .adapters import sql

ORDER = ["ln", "tie1", "tie2", "tie3"]
COLUMNS = ["chrom", "strand", "ref_start", "ref_end", "q_start", "q_end"]

NEXT = (
    ", adj AS (SELECT qname, "
    + ", ".join(COLUMNS)
    + ", "
    + ", ".join(f"lead({c}) OVER w AS n_{c}" for c in COLUMNS)
    + ", "
    + ", ".join(f"lead({c}, 2) OVER w AS m_{c}" for c in COLUMNS)
    + " FROM segments WINDOW w AS (PARTITION BY qname ORDER BY ln, tie1, tie2, tie3))\n"
)

#: CIGAR texts that lineitem gives, for both engines.
CIGAR = "concat(CAST(10 + l_linenumber AS STRING), 'S', CAST(l_partkey % 300 + 1 AS STRING), 'M', CAST(l_suppkey % 60 + 1 AS STRING), 'D', CAST(l_partkey % 77 + 20 AS STRING), 'M', CAST(l_orderkey % 90 + 1 AS STRING), 'I', '50M')"


def cigars(spark, d):
    rows = A.table(spark, d, "lineitem").selectExpr("l_orderkey * 100 + l_linenumber AS aid", "l_partkey * 50 AS ref_start", f"{CIGAR} AS text").distinct()
    return rows.withColumn("cigar", S.parse_cigar("text"))


PARTS = (
    ", c AS (SELECT DISTINCT l_orderkey * 100 + l_linenumber AS aid, l_partkey * 50 AS ref_start, "
    + CIGAR.replace("STRING", "VARCHAR")
    + """ AS text FROM lineitem),
parts AS (SELECT aid, ref_start, text, unnest(regexp_extract_all(text, '\\d+[A-Z=]')) AS p, generate_subscripts(regexp_extract_all(text, '\\d+[A-Z=]'), 1) AS ix FROM c),
ops AS (SELECT aid, ref_start, text, ix, right(p, 1) AS op, CAST(left(p, length(p) - 1) AS BIGINT) AS len FROM parts),
run AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER w, 0) AS r,
               coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END) OVER w, 0) AS q
        FROM ops WINDOW w AS (PARTITION BY aid, ref_start, text ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
)


@query(
    "K1_cigar_indels",
    sql(
        "WITH " + PARTS.lstrip(", ")
        + """SELECT aid, CASE WHEN op = 'I' THEN 'INS' ELSE 'DEL' END AS svtype, CAST(ref_start + r AS BIGINT) AS ref_pos, CAST(q AS BIGINT) AS q_pos, len
        FROM run WHERE op IN ('I', 'D') AND len >= 30"""
    ),
)
def cigar_indels(spark, d):
    return S.cigar_indels(cigars(spark, d), "aid", "ref_start", "cigar", 30)


@query(
    "F11_cigar_lengths",
    sql(
        "WITH " + PARTS.lstrip(", ")
        + """SELECT aid, text, CAST(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END) AS BIGINT) AS read_length,
        CAST(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) AS BIGINT) AS ref_length,
        CAST(sum(CASE WHEN ix = 1 AND op IN ('S', 'H') THEN len ELSE 0 END) AS BIGINT) AS head_clip FROM ops GROUP BY aid, ref_start, text"""
    ),
)
def cigar_lengths(spark, d):
    return cigars(spark, d).select(
        "aid", "text", S.read_length("cigar").alias("read_length"), S.reference_length("cigar").alias("ref_length"), S.clips("cigar")[0].alias("head_clip")
    )


@query(
    "W6_adjacent_segments",
    sql(NEXT + "SELECT qname, chrom, ref_start, n_chrom, n_ref_start FROM adj WHERE n_chrom IS NOT NULL", "segments"),
)
def adjacent_segments(spark, d):
    return S.adjacent(A.segments(spark, d), "qname", ORDER, ["chrom", "ref_start"])


@query(
    "K3_split_indels",
    sql(
        NEXT
        + """, s AS (SELECT *, (n_ref_start - ref_end) - (n_q_start - q_end) AS diff, ref_end - n_ref_start AS olap
                   FROM adj WHERE chrom = n_chrom AND strand = n_strand AND n_ref_start >= ref_start),
        k AS (SELECT *, CASE WHEN diff >= 30 THEN 'DEL' WHEN diff <= -30 THEN 'INS' END AS svtype FROM s WHERE abs(diff) <= 50000 AND olap < 3000)
        SELECT qname, chrom, svtype,
               CAST(CASE WHEN svtype = 'DEL' AND olap >= 30 THEN ref_end - diff WHEN svtype = 'DEL' THEN ref_end
                         WHEN abs(olap) > 400 THEN floor((ref_end + n_ref_start) / 2) ELSE n_ref_start END AS BIGINT) AS pos,
               CASE WHEN svtype = 'DEL' THEN diff ELSE abs(n_q_start - q_end + olap) END AS len
        FROM k WHERE svtype IS NOT NULL""",
        "segments",
    ),
)
def split_indels(spark, d):
    return S.split_indels(A.segments(spark, d), "qname", ORDER)


@query(
    "K6_segment_classes",
    sql(
        NEXT
        + """, g AS (SELECT *, CASE WHEN strand = '+' THEN n_ref_start - ref_end ELSE ref_start - n_ref_end END AS ref_gap, n_q_start - q_end AS read_gap FROM adj WHERE n_chrom IS NOT NULL),
        k AS (SELECT *, ref_gap - read_gap AS size, CASE WHEN chrom <> n_chrom THEN 'TRA' WHEN strand <> n_strand THEN 'INV'
              WHEN ref_gap < -30 AND read_gap <= 100 THEN 'DUP' WHEN ref_gap - read_gap BETWEEN 30 AND 100000 THEN 'DEL'
              WHEN read_gap - ref_gap BETWEEN 30 AND 100000 THEN 'INS' END AS svtype FROM g)
        SELECT qname, svtype, chrom, ref_end AS pos, n_chrom AS chrom2, n_ref_start AS pos2, size FROM k WHERE svtype IS NOT NULL""",
        "segments",
    ),
)
def segment_classes(spark, d):
    return S.segment_classes(A.segments(spark, d), "qname", ORDER)


@query(
    "W7_segment_triples",
    sql(
        NEXT
        + """SELECT qname, chrom, n_ref_start AS "start", n_ref_end AS "end", strand || n_strand || m_strand AS strands FROM adj
        WHERE chrom = n_chrom AND chrom = m_chrom AND strand <> n_strand AND strand = m_strand""",
        "segments",
    ),
)
def segment_triples(spark, d):
    return S.segment_triples(A.segments(spark, d), "qname", ORDER)


NUMBERED = ", num AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY ln, tie1, tie2, tie3) AS o FROM segments)\n"


def numbered(spark, d):
    from pyspark.sql import Window

    return A.segments(spark, d).withColumn("o", F.row_number().over(Window.partitionBy("qname").orderBy(*ORDER)))


@query(
    "J15_segment_pairs",
    sql(
        NUMBERED
        + """SELECT a.qname, a.o, b.o AS n_o, a.ref_start, b.ref_start AS n_ref_start FROM num a JOIN num b ON a.qname = b.qname AND a.o < b.o AND a.chrom = b.chrom AND a.strand = b.strand""",
        "segments",
    ),
)
def segment_pairs(spark, d):
    pairs = S.segment_pairs(numbered(spark, d), "qname", "o", ["chrom", "strand", "ref_start"])
    return pairs.where("chrom = n_chrom and strand = n_strand").select("qname", "o", "n_o", "ref_start", "n_ref_start")


@query(
    "K9_translocation_pairs",
    sql(
        NUMBERED
        + """SELECT a.qname, least(a.chrom, b.chrom) AS chrom1, greatest(a.chrom, b.chrom) AS chrom2, count(*) AS n, round(avg((a.mapq + b.mapq) / 2), 4) AS mapq
        FROM num a JOIN num b ON a.qname = b.qname AND a.o < b.o AND a.chrom <> b.chrom
        WHERE greatest(a.q_start, b.q_start) - least(a.q_end, b.q_end) <= 1000 GROUP BY ALL""",
        "segments",
    ),
)
def translocation_pairs(spark, d):
    pairs = S.segment_pairs(numbered(spark, d), "qname", "o", ["chrom", "q_start", "q_end", "mapq"])
    near = pairs.where("chrom <> n_chrom").where(F.greatest("q_start", "n_q_start") - F.least("q_end", "n_q_end") <= 1000)
    return near.groupBy("qname", F.least("chrom", "n_chrom").alias("chrom1"), F.greatest("chrom", "n_chrom").alias("chrom2")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("mapq") + F.col("n_mapq")) / 2), 4).alias("mapq")
    )


@query(
    "K10_duplication_pairs",
    sql(
        NUMBERED
        + """SELECT a.qname, least(a.ref_end, b.ref_start) AS "start", greatest(a.ref_end, b.ref_start) AS "end"
        FROM num a JOIN num b ON a.qname = b.qname AND a.o < b.o AND a.chrom = b.chrom AND a.strand = b.strand
        WHERE b.q_start - a.q_end <= 500 AND a.ref_start > b.ref_start""",
        "segments",
    ),
)
def duplication_pairs(spark, d):
    pairs = S.segment_pairs(numbered(spark, d), "qname", "o", COLUMNS)
    found = pairs.where("chrom = n_chrom and strand = n_strand and n_q_start - q_end <= 500 and ref_start > n_ref_start")
    return found.select("qname", F.least("ref_end", "n_ref_start").alias("start"), F.greatest("ref_end", "n_ref_start").alias("end"))


@query(
    "K8_split_evidence",
    sql(
        """SELECT qname, count(*) AS n, count(DISTINCT chrom) > 1 AS tra, count(DISTINCT strand) > 1 AS inv, count(DISTINCT strand) < count(*) AS dup
        FROM segments WHERE mapq >= 30 GROUP BY qname HAVING count(*) >= 2""",
        "segments",
    ),
)
def split_evidence(spark, d):
    return S.split_evidence(A.segments(spark, d), "qname", 30)


@query("A37_split_read_gate", sql("SELECT qname, count(*) AS n FROM segments WHERE mapq >= 50 GROUP BY qname HAVING count(*) > 1", "segments"))
def split_read_gate(spark, d):
    return A.segments(spark, d).where("mapq >= 50").groupBy("qname").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "A11_merge_within_read",
    sql(
        """, g AS (SELECT rname, svtype, chrom, list_sort(list({'pos': pos, 'len': svlen})) AS items FROM sigs GROUP BY ALL),
        f AS (SELECT rname, svtype, chrom, list_reduce(list_transform(items, lambda x: [x]), lambda acc, x:
              CASE WHEN x[1].pos - acc[len(acc)].pos <= 20000 THEN list_concat(acc[1:len(acc)-1], [{'pos': acc[len(acc)].pos, 'len': acc[len(acc)].len + x[1].len}])
                   ELSE list_concat(acc, x) END) AS m FROM g)
        SELECT rname, svtype, chrom, u.pos AS pos, u.len AS len FROM (SELECT rname, svtype, chrom, unnest(m) AS u FROM f)""",
        "sigs",
    ),
)
def merge_within_read(spark, d):
    keys = ["rname", "svtype", "chrom"]
    return S.merge_within_read(A.sigs(spark, d), keys, "pos", "svlen", lambda last, x: x["pos"] - last["pos"] <= 20000)


@query(
    "J20_lift_windows",
    sql(
        "WITH " + PARTS.lstrip(", ")
        + """, hit AS (SELECT *, greatest(ref_start + r, ref_start + 40) AS low, least(ref_start + r + len, ref_start + 200) AS high FROM run WHERE op IN ('M', '=', 'X'))
        SELECT aid, ref_start, text, CAST(min(q + low - ref_start - r) AS BIGINT) AS q_start, CAST(max(q + high - ref_start - r) AS BIGINT) AS q_end
        FROM hit WHERE low < high GROUP BY aid, ref_start, text"""
    ),
)
def lift_windows(spark, d):
    rows = cigars(spark, d).withColumn("key", F.struct("aid", "ref_start", "text")).withColumn("a", F.col("ref_start") + 40).withColumn("b", F.col("ref_start") + 200)
    return S.lift_window(rows, "key", "ref_start", "cigar", "a", "b").select("key.*", "q_start", "q_end")
