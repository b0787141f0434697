"""Queries of the interval and clustering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import intervals as I
from . import adapters as A
from . import query
from .adapters import sql

#: Islands of signatures, as a common table expression with the gap left open.
ISLANDS = """
, marked AS (
    SELECT *, CASE WHEN pos - lag(pos) OVER w <= {gap} THEN 0 ELSE 1 END AS new FROM sigs {where}
    WINDOW w AS (PARTITION BY chrom, svtype ORDER BY pos)
), isl AS (
    SELECT *, sum(new) OVER (PARTITION BY chrom, svtype ORDER BY pos, new DESC ROWS UNBOUNDED PRECEDING) AS cid FROM marked
)
"""


@query(
    "A1_gap_islands",
    sql(ISLANDS.format(gap=500, where="") + "SELECT chrom, svtype, CAST(cid AS BIGINT) AS cid, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM isl GROUP BY ALL", "sigs"),
)
def gap_islands(spark, d):
    rows = I.islands(A.sigs(spark, d), ["chrom", "svtype"], "pos", 500)
    return rows.groupBy("chrom", "svtype", "cid").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"))


@query(
    "A2_exclusive_islands_flanked",
    sql(
        """, marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) < 1800 THEN 0 ELSE 1 END AS new FROM points),
        isl AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos, new DESC ROWS UNBOUNDED PRECEDING) AS cid FROM marked)
        SELECT chrom, min(pos) - 7000 AS "start", max(pos) + 7000 AS "end", count(*) AS n FROM isl GROUP BY chrom, cid""",
        "points",
    ),
)
def exclusive_islands(spark, d):
    rows = I.islands(A.points(spark, d), ["chrom"], "pos", 1800, inclusive=False)
    return rows.groupBy("chrom", "cid").agg(
        (F.min("pos") - 7000).alias("start"), (F.max("pos") + 7000).alias("end"), F.count("*").alias("n")
    ).drop("cid")


REGION_SQL = ISLANDS.format(gap=500, where="WHERE svlen > 30") + """, found AS (
    SELECT chrom, svtype, min(pos) AS "start", max(pos) + CASE WHEN svtype = 'DEL' THEN max(svlen) ELSE 0 END AS "end", count(*) AS n
    FROM isl GROUP BY chrom, svtype, cid HAVING count(*) >= 3
)"""


@query("signature_regions", sql(REGION_SQL + 'SELECT chrom, svtype, "start", "end", n FROM found', "sigs"))
def signature_regions(spark, d):
    return C.signature_regions(A.sigs(spark, d))


MERGE = """, reach AS (
    SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {source}
), numbered AS (
    SELECT *, sum(CASE WHEN far IS NULL OR "start" - far >= {gap} THEN 1 ELSE 0 END)
              OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS cid FROM reach
)
SELECT chrom, greatest(min("start") - {flank}, 0) AS "start", max("end") + {flank} AS "end", count(*) AS n FROM numbered GROUP BY chrom, cid"""


@query("A4_merge_intervals", sql(MERGE.format(source="regions", gap=15000, flank=7000), "regions"))
def merge_intervals(spark, d):
    return I.merge_intervals(A.regions(spark, d), ["chrom"], "start", "end", 15000, flank=7000)


@query(
    "A5_union_of_regions",
    sql(REGION_SQL + ', every AS (SELECT chrom, "start", "end" FROM found UNION ALL SELECT chrom, "start", "end" FROM regions)' + MERGE.format(source="every", gap=15000, flank=0), "sigs", "regions"),
)
def union_of_regions(spark, d):
    found = C.signature_regions(A.sigs(spark, d)).select("chrom", "start", "end")
    every = found.unionByName(A.regions(spark, d).select("chrom", "start", "end"))
    return I.merge_intervals(every, ["chrom"], "start", "end", 15000)


@query(
    "A6_two_pass_chains",
    sql(
        """, m1 AS (SELECT *, CASE WHEN ref_start - lag(ref_start) OVER (PARTITION BY chrom ORDER BY ref_start) <= 20 THEN 0 ELSE 1 END AS n1 FROM segments),
        c1 AS (SELECT *, sum(n1) OVER (PARTITION BY chrom ORDER BY ref_start, n1 DESC ROWS UNBOUNDED PRECEDING) AS k1 FROM m1),
        m2 AS (SELECT *, CASE WHEN ref_end - lag(ref_end) OVER (PARTITION BY chrom, k1 ORDER BY ref_end) <= 20 THEN 0 ELSE 1 END AS n2 FROM c1),
        c2 AS (SELECT *, sum(n2) OVER (PARTITION BY chrom, k1 ORDER BY ref_end, n2 DESC ROWS UNBOUNDED PRECEDING) AS k2 FROM m2)
        SELECT chrom, CAST(floor(avg(ref_start)) AS BIGINT) AS ref_start, CAST(floor(avg(ref_end)) AS BIGINT) AS ref_end, count(*) AS n,
               round_even(avg(mapq), 1) AS mapq, round(stddev_pop(ref_start), 4) AS std_left, round(stddev_pop(ref_end), 4) AS std_right
        FROM c2 GROUP BY chrom, k1, k2 HAVING count(*) >= 2""",
        "segments",
    ),
)
def two_pass_chains(spark, d):
    rows = C.chain_clusters(A.segments(spark, d), ["chrom"], "ref_start", "ref_end", 20, least=2)
    return rows.withColumnRenamed("start", "ref_start").withColumnRenamed("end", "ref_end") if "start" in rows.columns else rows


@query(
    "A7_pair_chains",
    sql(
        """, pairs AS (SELECT DISTINCT chrom, ref_start, ref_end FROM segments),
        w AS (SELECT *, lag(ref_start) OVER o AS ps, lag(ref_end) OVER o AS pe FROM pairs WINDOW o AS (PARTITION BY chrom ORDER BY ref_start, ref_end)),
        c AS (SELECT *, sum(CASE WHEN ps IS NULL OR abs(ref_start - ps) > 100 OR abs(ref_end - pe) > 100 THEN 1 ELSE 0 END)
                        OVER (PARTITION BY chrom ORDER BY ref_start, ref_end) AS cid FROM w)
        SELECT chrom, CAST(floor(avg(ref_start)) AS BIGINT) AS "start", CAST(floor(avg(ref_end)) AS BIGINT) AS "end", count(*) AS n FROM c GROUP BY chrom, cid""",
        "segments",
    ),
)
def pair_chains(spark, d):
    pairs = A.segments(spark, d).select("chrom", "ref_start", "ref_end").distinct()
    return C.pair_chains(pairs, ["chrom"], "ref_start", "ref_end", 100, [])


@query("A8_first_fit_clusters")
def first_fit_clusters(spark, d):
    rows = A.segments(spark, d).select("chrom", "strand", "ref_start", "ref_end").distinct()
    found = C.first_fit(rows, ["chrom", "strand"], "ref_start", "ref_end", 100, [])
    return found.groupBy("chrom", "strand", "_island", "cluster").agg(
        F.floor(F.avg("ref_start")).alias("start"), F.floor(F.avg("ref_end")).alias("end"), F.count("*").alias("n")
    ).drop("_island", "cluster")


@query("A9_leader_clusters")
def leader_clusters(spark, d):
    rows = A.sigs(spark, d).select("chrom", "svtype", "pos", "svlen").distinct()
    return C.leaders(rows, ["chrom", "svtype"], 100, 0.5, [])


CLUSTER_SQL = ISLANDS.format(gap=200, where="") + """, one AS (
    SELECT chrom, svtype, cid, rname, svlen, pos,
           row_number() OVER (PARTITION BY chrom, svtype, cid, rname ORDER BY svlen DESC, pos) AS k FROM isl
), kept AS (
    SELECT chrom, svtype, cid, rname, svlen, pos, count(*) OVER (PARTITION BY chrom, svtype, cid) AS reads FROM one WHERE k = 1
)"""


@query(
    "A12_A13_read_clusters",
    sql(CLUSTER_SQL + "SELECT chrom, svtype, CAST(cid AS BIGINT) AS cid, count(*) AS reads, CAST(sum(svlen) AS BIGINT) AS length, min(pos) AS first_pos FROM kept WHERE reads >= 5 GROUP BY chrom, svtype, cid", "sigs"),
)
def read_clusters(spark, d):
    rows = C.read_signature_clusters(A.sigs(spark, d), 200, 5)
    return rows.groupBy("chrom", "svtype", "cid").agg(F.count("*").alias("reads"), F.sum("svlen").cast("long").alias("length"), F.min("pos").alias("first_pos"))


@query(
    "A14_A15_alleles",
    sql(
        CLUSTER_SQL
        + """, steps AS (
            SELECT *, CASE WHEN svlen - lag(svlen) OVER (PARTITION BY chrom, svtype, cid ORDER BY svlen, pos, rname)
                           > 0.5 * avg(svlen) OVER (PARTITION BY chrom, svtype, cid) THEN 1 ELSE 0 END AS new
            FROM kept WHERE reads >= 3
        ), parted AS (
            SELECT *, sum(new) OVER (PARTITION BY chrom, svtype, cid ORDER BY svlen, pos, rname) AS aid FROM steps
        )
        SELECT chrom, svtype, CAST(cid AS BIGINT) AS cid, CAST(aid AS BIGINT) AS aid, count(*) AS n,
               CAST(floor(avg(pos)) AS BIGINT) AS pos, CAST(floor(avg(svlen)) AS BIGINT) AS svlen,
               CAST(floor(1.96 * stddev_pop(pos) / sqrt(count(*))) AS BIGINT) AS ci_pos,
               CAST(floor(1.96 * stddev_pop(svlen) / sqrt(count(*))) AS BIGINT) AS ci_len
        FROM parted GROUP BY chrom, svtype, cid, aid HAVING count(*) >= 2""",
        "sigs",
    ),
)
def alleles(spark, d):
    found = C.alleles(C.read_signature_clusters(A.sigs(spark, d), 200, 3), 0.5, 2)
    return found.withColumn("aid", F.col("aid").cast("long"))


@query(
    "A17_complete_linkage",
)
def complete_linkage(spark, d):
    rows = A.sigs(spark, d).select("chrom", "svtype", "pos", "svlen").distinct()
    found = C.complete_linkage(rows, ["chrom", "svtype"], "pos", "svlen", 200)
    return found.groupBy("chrom", "svtype", "_island", "cluster").agg(F.min("pos").alias("pos"), F.max("svlen").alias("svlen"), F.count("*").alias("n")).drop("_island", "cluster")


@query(
    "A20_interval_depth",
    sql(
        """, r AS (SELECT DISTINCT chrom, pos AS r_start, pos + svlen AS r_end, rname FROM sigs),
        pairs AS (SELECT g.rid, greatest(g."start", r.r_start) AS s, least(g."end", r.r_end) AS e
                  FROM regions g JOIN r ON g.chrom = r.chrom AND r.r_start < g."end" AND r.r_end > g."start"),
        far AS (SELECT *, max(e) OVER (PARTITION BY rid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM pairs),
        sums AS (SELECT rid, sum(e - s) AS bases, sum(greatest(e - greatest(s, coalesce(f, s)), 0)) AS covered FROM far GROUP BY rid)
        SELECT g.rid AS iid, CAST(coalesce(bases, 0) AS BIGINT) AS bases, CAST(coalesce(covered, 0) AS BIGINT) AS covered,
               round(bases / nullif(covered, 0), 6) AS depth FROM regions g LEFT JOIN sums USING (rid)""",
        "sigs",
        "regions",
    ),
)
def interval_depth(spark, d):
    reads = A.sigs(spark, d).select("chrom", F.col("pos").alias("r_start"), (F.col("pos") + F.col("svlen")).alias("r_end"), "rname").distinct()
    rows = I.depth(A.regions(spark, d).withColumnRenamed("rid", "iid"), reads, ["chrom"])
    return rows.select("iid", F.col("bases").cast("long"), F.col("covered").cast("long"), F.round("depth", 6).alias("depth"))


@query(
    "A21_genome_bins",
    sql(
        """, b AS (SELECT chrom, pos, pos + svlen AS e, unnest(generate_series(pos // 500000, (pos + svlen - 1) // 500000)) AS bin FROM sigs)
        SELECT chrom, bin, CAST(sum(least(e, (bin + 1) * 500000) - greatest(pos, bin * 500000)) AS BIGINT) AS bases, count(*) AS n_reads FROM b GROUP BY chrom, bin""",
        "sigs",
    ),
)
def genome_bins(spark, d):
    reads = A.sigs(spark, d).select("chrom", F.col("pos").alias("r_start"), (F.col("pos") + F.col("svlen")).alias("r_end"))
    return I.coverage_bins(reads, ["chrom"], 500_000)


@query("A33_distinct_signatures", sql("SELECT DISTINCT chrom, svtype, pos, svlen, rname FROM sigs", "sigs"))
def distinct_signatures(spark, d):
    return A.sigs(spark, d).select("chrom", "svtype", "pos", "svlen", "rname").distinct()


@query("A34_weighted_bincount", sql("SELECT chrom, pos, CAST(sum(svlen) AS BIGINT) AS length FROM sigs WHERE svtype = 'INS' GROUP BY chrom, pos", "sigs"))
def weighted_bincount(spark, d):
    return A.sigs(spark, d).where("svtype = 'INS'").groupBy("chrom", "pos").agg(F.sum("svlen").alias("length"))


@query("S7_signature_counts", sql("SELECT chrom, svtype, pos, svlen, count(*) AS reads FROM sigs GROUP BY ALL", "sigs"))
def signature_counts(spark, d):
    return A.sigs(spark, d).groupBy("chrom", "svtype", "pos", "svlen").agg(F.count("*").alias("reads"))


@query(
    "streaming_islands",
    sql(
        """, marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 1800 THEN 0 ELSE 1 END AS new FROM points),
        isl AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos, new DESC ROWS UNBOUNDED PRECEDING) AS cid FROM marked)
        SELECT chrom, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM isl GROUP BY chrom, cid""",
        "points",
    ),
)
def streaming_islands(spark, d):
    from ..streaming.islands import stream_islands

    rows = A.points(spark, d).withColumn("time", F.timestamp_seconds("pos"))
    found = stream_islands(rows, "time", ["chrom"], "1800 seconds")
    second = lambda c: F.unix_timestamp(c).cast("long")
    return found.select("chrom", second("start").alias("first_pos"), second("last").alias("last_pos"), "n")
