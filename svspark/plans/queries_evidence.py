"""Queries of the evidence that split alignments give."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence as V
from ..operators import segments as S
from . import adapters as A
from . import query
from .adapters import sql
from .queries_segments import NEXT, NUMBERED, ORDER, PARTS, cigars, numbered

#: Events of a read's segments in order of the read; one SELECT for each kind of event.
EVENTS = """, o AS (
    SELECT *, row_number() OVER w AS ix, count(*) OVER (PARTITION BY qname) AS n, lead(chrom) OVER w AS bc, lead(strand) OVER w AS bs,
           lead(ref_start) OVER w AS bx, lead(ref_end) OVER w AS bz, lead(q_start) OVER w AS bq, lead(q_end) OVER w AS be,
           lead(chrom, 2) OVER w AS cc, lead(strand, 2) OVER w AS cs, lead(ref_start, 2) OVER w AS cx, lead(ref_end, 2) OVER w AS cy, lead(q_start, 2) OVER w AS cq,
           last_value(chrom) OVER all_ AS lc, last_value(strand) OVER all_ AS ls, last_value(ref_start) OVER all_ AS lx, last_value(ref_end) OVER all_ AS ly, last_value(q_start) OVER all_ AS lq
    FROM segments
    WINDOW w AS (PARTITION BY qname ORDER BY q_start, ln, tie1, tie2, tie3),
           all_ AS (PARTITION BY qname ORDER BY q_start, ln, tie1, tie2, tie3 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), p AS (
    SELECT *, chrom <> bc AS away, chrom = bc AND strand = bs AS same, bq - q_end AS qg,
           CASE WHEN strand = '+' THEN ref_end ELSE bz END AS l, CASE WHEN strand = '+' THEN bx ELSE ref_start END AS r
    FROM o WHERE n <= 7 AND bc IS NOT NULL
), g AS (
    SELECT *, r - l AS rg, r - l - qg AS size, bool_or(away) OVER (PARTITION BY qname) AS tra,
           chrom = bc AND bc = cc AS three, CASE WHEN strand = '+' THEN ref_end ELSE ref_start END AS ae, CASE WHEN strand = '+' THEN bz ELSE bx END AS bf,
           CASE WHEN bs = '+' THEN bz ELSE bx END AS be2, CASE WHEN bs = '+' THEN cy ELSE cx END AS cf, CASE WHEN bs = '+' THEN bx ELSE bz END AS bo,
           CASE WHEN strand = '+' THEN cx - ref_end ELSE ref_start - cy END AS room,
           CASE WHEN strand = '+' THEN ref_end ELSE ly END AS fl, CASE WHEN strand = '+' THEN lx ELSE ref_start END AS fr
    FROM p
), e AS (
    SELECT qname, 'DUP' AS svtype, '' AS form, chrom, r AS pos, chrom AS chrom2, l AS pos2, -rg AS size FROM g WHERE same AND rg <= -30
    UNION ALL SELECT qname, 'INS', '', chrom, (l + r) / 2, chrom, (l + r) / 2, -size FROM g WHERE same AND rg > -30 AND size <= -30 AND rg <= 100 AND -size <= 100000
    UNION ALL SELECT qname, 'DEL', '', chrom, l, chrom, l + size, size FROM g WHERE same AND rg > -30 AND size >= 30 AND qg <= 100 AND size <= 100000
    UNION ALL SELECT qname, 'TRA', CASE WHEN strand || bs = '+-' THEN 'B' WHEN strand || bs = '-+' THEN 'C' WHEN strand || bs = '++' THEN 'A' ELSE 'D' END, chrom, ae, bc, bo, 0
              FROM g WHERE away AND qg <= 100 AND chrom < bc
    UNION ALL SELECT qname, 'TRA', CASE WHEN strand || bs = '+-' THEN 'B' WHEN strand || bs = '-+' THEN 'C' WHEN strand || bs = '++' THEN 'D' ELSE 'A' END, bc, bo, chrom, ae, 0
              FROM g WHERE away AND qg <= 100 AND chrom > bc
    UNION ALL SELECT qname, 'INV', CASE WHEN strand = '+' THEN '++' ELSE '--' END, chrom, least(ae, bf), chrom, greatest(ae, bf), abs(ae - bf) FROM g
              WHERE chrom = bc AND strand <> bs AND (n = 2 OR (three AND strand <> cs)) AND abs(ae - bf) >= 30 AND bq + 0.5 * abs(ae - bf) >= q_end
    UNION ALL SELECT qname, 'INV', CASE WHEN bs = '+' THEN '++' ELSE '--' END, chrom, least(be2, cf), chrom, greatest(be2, cf), abs(be2 - cf) FROM g
              WHERE three AND strand = bs AND strand <> cs AND abs(be2 - cf) >= 30 AND cq + 0.5 * abs(be2 - cf) >= be
    UNION ALL SELECT qname, 'INV', '++', chrom, CASE WHEN strand = '+' THEN ref_end ELSE cy END, chrom, bz, abs(bz - CASE WHEN strand = '+' THEN ref_end ELSE cy END) FROM g
              WHERE three AND strand = cs AND strand <> bs AND bq + 0.5 * room >= q_end AND cq + 0.5 * room >= be
    UNION ALL SELECT qname, 'INV', '--', chrom, bx, chrom, CASE WHEN strand = '+' THEN cx ELSE ref_start END, abs(CASE WHEN strand = '+' THEN cx ELSE ref_start END - bx) FROM g
              WHERE three AND strand = cs AND strand <> bs AND bq + 0.5 * room >= q_end AND cq + 0.5 * room >= be
    UNION ALL SELECT qname, 'INS', 'ends', chrom, least(fl, fr), chrom, least(fl, fr), (lq - q_end) - (fr - fl) FROM g
              WHERE ix = 1 AND n >= 3 AND tra AND chrom = lc AND strand = ls AND fr - fl < 100 AND (lq - q_end) - (fr - fl) BETWEEN 30 AND 100000
    UNION ALL SELECT qname, 'DUP', 'ends', chrom, fr, chrom, fl, fl - fr FROM g WHERE ix = 1 AND n >= 3 AND tra AND chrom = lc AND strand = ls AND fr - fl <= -30
)
"""


@query(
    "K6_split_read_events",
    sql(EVENTS + "SELECT qname, svtype, form, chrom, CAST(pos AS DOUBLE) AS pos, chrom2, CAST(pos2 AS DOUBLE) AS pos2, CAST(size AS BIGINT) AS size FROM e", "segments"),
)
def split_read_events(spark, d):
    return V.split_read_events(A.segments(spark, d), "qname", ORDER)


@query(
    "K2_raw_read_indels",
    sql(
        "WITH " + PARTS.lstrip(", ")
        + """, big AS (SELECT *, sum(CASE WHEN op = 'I' AND len >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY aid, ref_start, text ORDER BY ix) AS k FROM run)
        SELECT aid, CASE WHEN op = 'I' THEN 'INS' ELSE 'DEL' END AS svtype, CAST(ref_start + r + CASE WHEN op = 'I' THEN k ELSE 0 END AS BIGINT) AS ref_pos,
               CAST(q AS BIGINT) AS q_pos, len FROM big WHERE op IN ('I', 'D') AND len >= 30"""
    ),
)
def raw_read_indels(spark, d):
    return S.cigar_indels(cigars(spark, d), "aid", "ref_start", "cigar", 30, step=1)


@query(
    "K5_raw_split_indels",
    sql(
        NEXT
        + """, s AS (SELECT *, (n_ref_start - ref_end) - (n_q_start - q_end) AS diff FROM adj WHERE chrom = n_chrom AND strand = n_strand AND n_ref_start >= ref_start AND ref_end - n_ref_start < 30)
        SELECT qname, chrom, CASE WHEN diff > 0 THEN 'DEL' ELSE 'INS' END AS svtype,
               CAST(CASE WHEN diff > 0 THEN ref_end ELSE floor((ref_end + n_ref_start) / 2) END AS BIGINT) AS pos, abs(diff) AS len FROM s WHERE abs(diff) BETWEEN 30 AND 50000""",
        "segments",
    ),
)
def raw_split_indels(spark, d):
    return V.raw_split_indels(A.segments(spark, d), "qname", ORDER)


def measured(spark, d):
    """Numbered segments with their read's length: its last aligned base and 100 that are clipped."""
    return numbered(spark, d).withColumn("read_len", F.max("q_end").over(Window.partitionBy("qname")) + 100)


PAIR_TEST = (
    NUMBERED
    + """, m AS (SELECT *, max(q_end) OVER (PARTITION BY qname) + 100 AS read_len, CASE WHEN strand = '+' THEN ref_start ELSE ref_end END AS f,
                      CASE WHEN strand = '+' THEN ref_end ELSE ref_start END AS t FROM num),
    pr AS (SELECT a.qname, a.chrom, CASE WHEN b.q_start >= a.q_start THEN b.f ELSE a.f END AS x, CASE WHEN a.q_end <= b.q_end THEN a.t ELSE b.t END AS y,
                  abs(greatest(a.q_start, b.q_start) - least(a.q_end, b.q_end)) AS dist, (a.q_end - a.q_start + b.q_end - b.q_start) / a.read_len AS held, (a.mapq + b.mapq) / 2 AS mapq
           FROM m a JOIN m b ON a.qname = b.qname AND a.o < b.o AND a.chrom = b.chrom AND a.strand {same} b.strand)
    SELECT qname, chrom, least(x, y) AS "start", greatest(x, y) AS "end", mapq FROM pr WHERE dist <= greatest(1000, abs(x - y) * {share}) AND held >= {covered}"""
)


@query("K9_duplication_test", sql(PAIR_TEST.format(same="=", share="0.0", covered="0.2"), "segments"))
def duplication_test(spark, d):
    return V.tested_pairs(measured(spark, d), "qname", "o", "DUP", covered=0.2)


@query("K9_inversion_test", sql(PAIR_TEST.format(same="<>", share="0.15", covered="0.2"), "segments"))
def inversion_test(spark, d):
    return V.tested_pairs(measured(spark, d), "qname", "o", "INV", covered=0.2, share=0.15)


def targets(spark, d):
    """Two windows of 10,000 bases each for every part: where an inversion may start and end."""
    return A.table(spark, d, "part").selectExpr(
        "p_partkey AS tid", "concat('chr', CAST(p_partkey % 3 + 1 AS STRING)) AS chrom", "p_partkey * 50 - 5000 AS start1", "p_partkey * 50 + 5000 AS end1",
        "p_partkey * 50 - 3000 + p_size * 100 AS start2", "p_partkey * 50 + 7000 + p_size * 100 AS end2",
    )


@query("K11_inversions_in_targets")
def inversions_in_targets(spark, d):
    return V.inversions_in_targets(A.segments(spark, d), targets(spark, d), "qname", reach=500)  # segments of these reads lie that far apart


@query("K12_translocations_in_passes")
def translocations_in_passes(spark, d):
    return V.translocations_in_passes(numbered(spark, d), "qname", "o")


#: Segments that follow each other closely on the read, with places on three stretches of a chromosome.
CLOSE = "q_start, q_start + 570 + tie2 % 60 AS q_end, chrom, strand, ref_start % 4000 AS ref_start, ref_start % 4000 + ref_end - ref_start AS ref_end"


def events(spark, d):
    rows = A.segments(spark, d).selectExpr("qname", "ln", "tie1", "tie2", "tie3", *[c.strip() for c in CLOSE.split(",")])
    return V.adjacencies(rows, "qname", ORDER)


ADJACENT = f""", s AS (SELECT qname, ln, tie1, tie2, tie3, {CLOSE} FROM segments),
n AS (SELECT *, row_number() OVER w AS ix, lead(chrom) OVER w AS c2, lead(strand) OVER w AS s2, lead(ref_start) OVER w AS x2, lead(ref_end) OVER w AS y2, lead(q_start) OVER w - q_end AS g
      FROM s WINDOW w AS (PARTITION BY qname ORDER BY q_start, q_end, ln, tie1, tie2, tie3)),
d AS (SELECT *, strand = '+' AS plus, s2 = '+' AS plus2, CASE WHEN strand <> s2 THEN CASE WHEN strand = '+' THEN y2 - ref_end ELSE x2 - ref_start END
                                WHEN strand = '+' THEN x2 - ref_end ELSE ref_start - y2 END AS r FROM n WHERE c2 IS NOT NULL AND g >= -50),
k AS (SELECT *, g - r AS m, CASE WHEN strand = '+' THEN y2 > ref_start ELSE x2 < ref_end END AS full_, x2 - ref_end >= -50 AS ahead, ref_start - y2 >= -50 AS behind FROM d),
t AS (SELECT *, CASE WHEN chrom <> c2 THEN CASE WHEN g <= 50 THEN 'BND' END
    WHEN strand = s2 AND r >= -50 AND m >= 40 THEN CASE WHEN r <= 50 THEN 'INS' END
    WHEN strand = s2 AND r >= -50 THEN CASE WHEN g <= 50 AND m BETWEEN -100000 AND -40 THEN 'DEL' WHEN g <= 50 AND m < -100000 THEN 'BND' END
    WHEN strand = s2 THEN CASE WHEN g <= 50 AND m >= 40 THEN CASE WHEN full_ OR r >= -100000 THEN 'DUP' ELSE 'BND' END END
    WHEN g <= 50 AND ahead THEN CASE WHEN -m BETWEEN 40 AND 100000 THEN 'INV' ELSE 'BND' END
    WHEN g <= 50 AND behind THEN CASE WHEN m BETWEEN 40 AND 100000 THEN 'INV' ELSE 'BND' END END AS svtype FROM k),
ev AS (SELECT qname, ix, svtype, CASE svtype WHEN 'DUP' THEN CASE WHEN plus THEN 'fwd' ELSE 'rev' END || CASE WHEN full_ THEN '+' ELSE '' END
        WHEN 'INV' THEN CASE WHEN plus THEN 'left_' ELSE 'right_' END || CASE WHEN ahead THEN 'fwd' ELSE 'rev' END
        WHEN 'BND' THEN CASE WHEN plus THEN 'fwd' ELSE 'rev' END || '_' || CASE WHEN plus2 THEN 'fwd' ELSE 'rev' END ELSE '' END AS form, chrom,
    CASE svtype WHEN 'INS' THEN CASE WHEN plus THEN ref_end ELSE ref_start END WHEN 'DEL' THEN CASE WHEN plus THEN ref_end ELSE y2 END WHEN 'DUP' THEN CASE WHEN plus THEN x2 ELSE ref_start END
        WHEN 'INV' THEN CASE WHEN ahead THEN CASE WHEN plus THEN ref_end ELSE ref_start END ELSE CASE WHEN plus THEN y2 ELSE x2 END END
        ELSE CASE WHEN plus THEN ref_end - 1 ELSE ref_start END END AS b, c2, x2, y2, plus2, abs(m) AS size FROM t WHERE svtype IS NOT NULL),
e AS (SELECT qname, ix, svtype, form, chrom, b, c2, CASE WHEN svtype = 'BND' THEN CASE WHEN plus2 THEN x2 ELSE y2 - 1 END ELSE b + size END AS f, size FROM ev)
"""


@query("K7_adjacencies", sql(ADJACENT + 'SELECT qname, svtype, form, chrom, b AS "start", c2 AS chrom2, f AS "end", size FROM e', "segments"))
def adjacencies(spark, d):
    return events(spark, d).drop("at")


@query("K7_tandem_runs")
def tandem_runs(spark, d):
    return V.tandem_runs(events(spark, d), "qname")


@query(
    "K7_interspersed_duplications",
    sql(
        ADJACENT
        + """SELECT x.qname, x.c2 AS chrom, CASE WHEN x.form = 'fwd_fwd' THEN x.f ELSE y.b END AS "start", CASE WHEN x.form = 'fwd_fwd' THEN y.b + 1 ELSE x.f + 1 END AS "end",
               x.chrom AS dest_chrom, CAST(floor((x.b + 1 + y.f) / 2) AS BIGINT) AS dest
        FROM e x JOIN e y ON x.qname = y.qname AND x.ix < y.ix AND x.svtype = 'BND' AND y.svtype = 'BND' AND x.form = y.form AND x.form IN ('fwd_fwd', 'rev_rev')
             AND x.chrom = y.c2 AND abs(x.b - y.f) < 400 AND x.c2 = y.chrom
        WHERE CASE WHEN x.form = 'fwd_fwd' THEN y.b + 1 - x.f ELSE x.f + 1 - y.b END BETWEEN 40 AND 100000""",
        "segments",
    ),
)
def interspersed_duplications(spark, d):
    return V.interspersed_duplications(events(spark, d), "qname", within=400)  # these segments don't meet more closely


@query("K7_paired_inversions")
def paired_inversions(spark, d):
    return V.paired_inversions(events(spark, d), "qname")
