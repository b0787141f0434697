"""Queries that pair the candidates of two haplotypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import settled
from ..operators import haplotypes as H
from ..sources import reference as R
from . import adapters as A
from . import query
from .adapters import sql
from .queries_evidence import events

#: Three candidates of each haplotype on every sequence of 1,600 bases and more, all of one type: shifted, and longer or shorter.
CANDIDATES = """
sid * 6 + n AS cid;
CAST(n % 2 + 1 AS INT) AS hap;
CASE sid % 5 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' WHEN 2 THEN 'INV' WHEN 3 THEN 'DUP_TAN' ELSE 'DUP_INT' END AS svtype;
concat('s', CAST(sid AS STRING)) AS chrom;
300 + (sid * 13) % 400 + (n - n % 2) * 20 + (n * sid) % 6 AS start;
300 + (sid * 13) % 400 + (n - n % 2) * 20 + (n * sid) % 6 + 50 + sid % 90 + (n * sid) % 4 AS end;
substring(seq, CAST(900 + (n * sid) % 3 AS INT), CAST(50 + sid % 90 + (n * sid) % 5 AS INT)) AS seq;
CAST(1 + (sid + n) % 2 AS INT) AS copies;
concat('s', CAST(sid AS STRING)) AS src_chrom;
1000 + (n * sid) % 4 AS src_start;
1050 + sid % 90 + (n * sid) % 7 AS src_end
"""
CANDIDATE_SQL = (
    ", c AS (SELECT "
    + CANDIDATES.strip().replace(";\n", ",\n").replace("AS STRING", "AS VARCHAR").replace("AS start", 'AS "start"').replace("AS end", 'AS "end"')
    + " FROM (SELECT sid, seq, unnest(generate_series(0, 5)) AS n FROM seqs WHERE length(seq) >= 1600))"
)


def candidates(spark, d):
    s = A.sequences(spark, d).where("length(seq) >= 1600").select("sid", "seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("n"))
    return s.selectExpr(*[c.strip() for c in CANDIDATES.strip().split(";\n")])


def blocks(spark, d):
    names = A.sequences(spark, d).select(F.concat(F.lit("s"), F.col("sid").cast("string")).alias("name"), "seq")
    return R.blocks_of(names, block=1024)


@query(
    "A17_haplotype_distances",
    sql(
        CANDIDATE_SQL
        + """, p AS (
            SELECT a.cid AS a, b.cid AS b, a.svtype, s.seq AS ref, greatest(least(a."start", b."start") - 100, 0) AS low,
                   CASE WHEN a.svtype IN ('INS', 'DUP_INT') THEN greatest(a."start", b."start") ELSE greatest(a."end", b."end") END + 100 AS high,
                   a."start" AS s1, a."end" AS e1, a.seq AS q1, a.copies AS k1, a.src_start AS x1, a.src_end AS y1,
                   b."start" AS s2, b."end" AS e2, b.seq AS q2, b.copies AS k2, b.src_start AS x2, b.src_end AS y2
            FROM c a JOIN c b ON a.chrom = b.chrom AND a.hap = 1 AND b.hap = 2 JOIN seqs s ON a.chrom = concat('s', s.sid)
        ), h AS (
            SELECT a, b, """
        + ", ".join(
            f"""concat(substr(ref, low + 1, s{k} - low), CASE svtype WHEN 'DEL' THEN '' WHEN 'INS' THEN q{k}
                WHEN 'INV' THEN reverse(translate(substr(ref, s{k} + 1, e{k} - s{k}), 'ACGT', 'TGCA')) WHEN 'DUP_TAN' THEN repeat(substr(ref, s{k} + 1, e{k} - s{k}), k{k} + 1)
                ELSE substr(ref, x{k} + 1, y{k} - x{k}) END,
                CASE WHEN svtype IN ('INS', 'DUP_INT') THEN substr(ref, s{k} + 1, high - s{k}) ELSE substr(ref, e{k} + 1, high - e{k}) END) AS h{k}"""
            for k in (1, 2)
        )
        + """ FROM p)
        SELECT a, b, CAST(levenshtein(h1, h2) AS BIGINT) AS d FROM h WHERE levenshtein(h1, h2) <= 200""",
        "seqs",
    ),
)
def haplotype_distances(spark, d):
    return H.haplotype_distances(settled(candidates(spark, d)), blocks(spark, d), block=1024)


@query("A17_paired_haplotypes")
def paired_haplotypes(spark, d):
    found = H.pair_haplotypes(settled(candidates(spark, d)), blocks(spark, d), block=1024)
    return found.select("cid", "hap", "svtype", "chrom", "start", "end", "other", "gt", "d")


def breakends(spark, d):
    """The breakends of assembled reads, each read of one of two haplotypes."""
    rows = events(spark, d).where("svtype = 'BND'")
    return rows.select((F.col("qname") * 8 + F.col("at")).alias("cid"), (F.col("qname") % 2 + 1).cast("int").alias("hap"), "chrom", "start", "chrom2", "end", "form")


@query("A17_paired_breakends")
def paired_breakends(spark, d):
    return H.pair_breakends(settled(breakends(spark, d)))
