"""Queries of the operators that finish call sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import calls as K
from ..operators import matching as M
from ..operators import segments as S
from ..operators.intervals import overlap_pairs
from . import adapters as A
from . import query
from .adapters import sql
from .queries_matching import CALLS, ON, TRUTH, calls, matched, renamed, support
from .queries_scalars import GT_RULES, GT_VALUES
from .queries_segments import NEXT, ORDER, PARTS, cigars, numbered

RULES = ", ".join(f"({', '.join(repr(x) for x in r)})" for r in K.DUP_RULES)


@query(
    "P7_second_duplication_filter",
    sql(
        f""", rules(dtype, state, dl, dh, sl, sh, mq, cl, ch, su, zl, zh, ei) AS (VALUES {RULES}),
        c AS (SELECT chrom, pos // 20000 AS place, count(*) AS n_sup, avg(mapq) + 20 AS mapq, max(svlen) * 3 AS size, stddev_pop(pos) / 2000 AS std_left, stddev_pop(svlen) / 200 AS std_right,
              sum(svlen) / 800.0 AS cov_sv, min(svlen) % 9 AS cov_left, max(svlen) % 7 AS cov_right FROM sigs GROUP BY ALL),
        m AS (SELECT *, 2 * cov_sv / nullif(cov_left + cov_right, 0) AS rd, 2.0 * n_sup / nullif(cov_left + cov_right, 0) AS rs, cov_sv / 5.0 AS rc, least(std_left, std_right) AS st FROM c)
        SELECT dtype, state, count(*) AS n FROM m JOIN rules ON rd BETWEEN dl AND dh AND rs BETWEEN sl AND sh AND mapq > mq AND rc BETWEEN cl AND ch
            AND st / n_sup < su AND size BETWEEN zl AND zh AND st < ei GROUP BY ALL""",
        "sigs",
    ),
)
def second_duplication_filter(spark, d):
    c = A.sigs(spark, d).groupBy("chrom", F.expr("pos div 20000").alias("place")).agg(
        F.count("*").alias("n_sup"), (F.avg("mapq") + 20).alias("mapq"), (F.max("svlen") * 3).alias("size"), (F.stddev_pop("pos") / 2000).alias("std_left"),
        (F.stddev_pop("svlen") / 200).alias("std_right"), (F.sum("svlen") / 800.0).alias("cov_sv"), (F.min("svlen") % 9).alias("cov_left"), (F.max("svlen") % 7).alias("cov_right"),
    )
    rules = spark.createDataFrame(K.DUP_RULES, K.DUP_RULE_FIELDS)
    return K.second_duplication_filter(c, rules, 5.0).groupBy("dtype", "state").agg(F.count("*").alias("n"))


@query(
    "P10_quiet_alignments",
    sql(
        "WITH " + PARTS.lstrip(", ")
        + """, s AS (SELECT aid, ref_start, text, sum(CASE WHEN op = 'I' THEN len ELSE 0 END) AS ins, sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END) AS read,
             sum(CASE WHEN op = 'M' THEN len ELSE 0 END) AS m, count(*) FILTER (op = 'M') AS runs FROM ops GROUP BY aid, ref_start, text)
        SELECT aid, text FROM s WHERE ins::DOUBLE / read <= 0.13 OR m::DOUBLE / runs >= 100"""
    ),
)
def quiet_alignments(spark, d):
    return K.quiet_alignments(cigars(spark, d), "cigar", 0.13, 100).select("aid", "text")


@query(
    "P17_informative_cells",
    sql(
        """, r AS (SELECT user_id AS cell, avg(CASE WHEN tool = 'view' THEN CASE WHEN value > 50 THEN 1.0 ELSE -1.0 END END) AS mat,
                   avg(CASE WHEN tool = 'click' THEN CASE WHEN value > 50 THEN 1.0 ELSE -1.0 END END) AS pat FROM points GROUP BY user_id)
        SELECT cell, round(mat, 6) AS mat, round(pat, 6) AS pat FROM r WHERE mat * pat < 0 AND least(abs(mat), abs(pat)) > 0.2""",
        "points",
    ),
)
def informative_cells(spark, d):
    sign = F.when(F.col("value") > 50, 1.0).otherwise(-1.0)
    ratio = lambda t: F.avg(F.when(F.col("tool") == t, sign))
    cells = A.points(spark, d).groupBy(F.col("user_id").alias("cell")).agg(ratio("view").alias("mat"), ratio("click").alias("pat"))
    return K.informative_cells(cells, 0.2).select("cell", F.round("mat", 6).alias("mat"), F.round("pat", 6).alias("pat"))


@query(
    "J13_F22_breakpoint_shift",
    sql(
        CALLS + TRUTH
        + """SELECT c.cid, h.tid, least(greatest(abs(c.pos - t.pos), abs(c.pos + c.svlen - t.pos - t.svlen)), 201) AS shift
        FROM hits h JOIN calls c USING (cid) JOIN truth t ON t.cid = h.tid""",
        "sigs",
    ),
)
def breakpoint_shift(spark, d):
    t = calls(spark, d, "A").select(F.col("cid").alias("tid"), F.col("pos").alias("t_start"), (F.col("pos") + F.col("svlen")).alias("t_end"))
    return K.breakpoint_shift(matched(spark, d).join(t, "tid")).select("cid", "tid", "shift")


@query(
    "J17_K16_recovered_duplications",
    sql(
        CALLS
        + """, k AS (SELECT c.cid, c.pos, c.svlen, t.pos AS ks, t.pos + t.svlen AS ke, least(abs(c.pos - t.pos), abs(c.pos - t.pos - t.svlen)) AS edge,
                   least(c.svlen, t.svlen)::DOUBLE / greatest(c.svlen, t.svlen) AS alike
                   FROM calls c JOIN truth t ON c.chrom = t.chrom AND abs(c.pos - t.pos) <= 2000 WHERE c.svtype = 'INS'),
        f AS (SELECT *, edge::DOUBLE / svlen AS rel FROM k WHERE alike >= 0.7 AND edge <= 300 AND edge::DOUBLE / svlen <= 0.3),
        z AS (SELECT *, round((alike - avg(alike) OVER w) / (stddev_pop(alike) OVER w + 1e-4) - (edge - avg(edge) OVER w) / (stddev_pop(edge) OVER w + 1e-4)
                   - (rel - avg(rel) OVER w) / (stddev_pop(rel) OVER w + 1e-4), 6) AS score FROM f WINDOW w AS (PARTITION BY cid))
        SELECT cid, ks AS k_start, edge, round(alike, 6) AS alike FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY score DESC, ks, ke) AS n FROM z) WHERE n = 1""",
        "sigs",
    ),
)
def recovered_duplications(spark, d):
    t = calls(spark, d, "A").select(F.col("chrom"), F.col("pos").alias("k_start"), (F.col("pos") + F.col("svlen")).alias("k_end"), F.col("chrom").alias("k_chrom"))
    pairs = M.within(calls(spark, d).where("svtype = 'INS'"), t, ["chrom"], "pos", "k_start", 2000)
    return K.recovered_duplications(pairs).select("cid", "k_start", "edge", F.round("like", 6).alias("alike"))


PHASED = """, phased AS (SELECT DISTINCT chrom, rname * 100 + ln AS qname, pos AS r_start, pos + svlen AS r_end, CASE WHEN rname % 3 > 0 THEN pos // 30000 END AS ps, rname % 2 + 1 AS hp FROM sigs),
blocks AS (SELECT chrom, ps, min(r_start) AS "start", max(r_end) AS "end", count(*) FILTER (hp = 1) AS hp1, count(*) FILTER (hp = 2) AS hp2 FROM phased WHERE ps IS NOT NULL GROUP BY chrom, ps)
"""


def phased(spark, d):
    return A.sigs(spark, d).select(
        "chrom", (F.col("rname") * 100 + F.col("ln")).alias("qname"), F.col("pos").alias("r_start"), (F.col("pos") + F.col("svlen")).alias("r_end"),
        F.when(F.col("rname") % 3 > 0, F.expr("pos div 30000")).alias("ps"), (F.col("rname") % 2 + 1).alias("hp"),
    ).distinct()


@query("K13_phase_blocks", sql(PHASED + "SELECT * FROM blocks", "sigs"))
def phase_blocks(spark, d):
    return K.phase_blocks(phased(spark, d))


@query(
    "J19_unphased_reads",
    sql(
        PHASED
        + """, p AS (SELECT r.qname, b.ps, least(r.r_end, b."end") - greatest(r.r_start, b."start") AS o FROM phased r JOIN blocks b ON r.chrom = b.chrom AND r.r_start < b."end" AND r.r_end > b."start" WHERE r.ps IS NULL)
        SELECT qname, ps, o AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY o DESC, ps) AS k FROM p) WHERE k = 1""",
        "sigs",
    ),
)
def unphased_reads(spark, d):
    reads = phased(spark, d)
    return K.assign_unphased(reads.where("ps is null").drop("ps", "hp"), K.phase_blocks(reads))


@query(
    "A10_merge_within_contig",
    sql(
        """, g AS (SELECT okey, chrom, list_sort(list({'pos': pos, 'len': svlen})) AS items FROM sigs WHERE svtype = 'INS' GROUP BY ALL),
        f AS (SELECT okey, chrom, list_reduce(list_transform(items, lambda x: [x]), lambda acc, x:
              CASE WHEN (acc[len(acc)].len > 250 AND x[1].len > 250 AND x[1].pos - acc[len(acc)].pos < 250) OR (acc[len(acc)].len > 320 AND x[1].len > 320 AND x[1].pos - acc[len(acc)].pos < 380)
                        OR (acc[len(acc)].len > 100 AND x[1].len > 100 AND x[1].pos - acc[len(acc)].pos < 250)
                   THEN list_concat(acc[1:len(acc)-1], [{'pos': acc[len(acc)].pos, 'len': acc[len(acc)].len + x[1].len}]) ELSE list_concat(acc, x) END) AS m FROM g)
        SELECT okey, chrom, u.pos AS pos, u.len AS len FROM (SELECT okey, chrom, unnest(m) AS u FROM f)""",
        "sigs",
    ),
)
def merge_within_contig(spark, d):
    def rule(last, x):
        step = x["pos"] - last["pos"]
        both = lambda n: (last["len"] > n) & (x["len"] > n)
        return (both(250) & (step < 250)) | (both(320) & (step < 380)) | (both(100) & (step < 250))

    return S.merge_within_read(A.sigs(spark, d).where("svtype = 'INS'"), ["okey", "chrom"], "pos", "svlen", rule)


@query(
    "A18_A19_diploid_genotypes",
    sql(
        """, h AS (SELECT DISTINCT chrom, svtype, pos, svlen, ln % 2 + 1 AS hap, (2 * pos + svlen) // 2 AS mid FROM sigs),
        m AS (SELECT *, CASE WHEN mid - lag(mid) OVER (PARTITION BY chrom, svtype ORDER BY mid) <= 100 THEN 0 ELSE 1 END AS new FROM h),
        c AS (SELECT *, sum(new) OVER (PARTITION BY chrom, svtype ORDER BY mid, new DESC ROWS UNBOUNDED PRECEDING) AS cid FROM m)
        SELECT chrom, svtype, CAST(floor(avg(pos)) AS BIGINT) AS pos, CAST(round_even(avg(svlen), 0) AS BIGINT) AS svlen,
               CASE bit_or(CAST(hap AS INT)) WHEN 3 THEN '1/1' WHEN 1 THEN '1/0' ELSE '0/1' END AS gt, count(*) AS n FROM c GROUP BY chrom, svtype, cid""",
        "sigs",
    ),
)
def diploid_genotypes(spark, d):
    h = A.sigs(spark, d).select(*ON, "pos", "svlen", (F.col("ln") % 2 + 1).alias("hap")).distinct()
    return K.diploid_genotypes(h, ON, 100)


@query(
    "A23_block_quality",
    sql(
        PHASED
        + """, q AS (SELECT ps, hp, CASE WHEN qname % 4 = 0 THEN 'M' ELSE 'P' END AS parent FROM phased WHERE ps IS NOT NULL),
        s AS (SELECT ps, avg(CASE WHEN hp = 1 THEN CASE WHEN parent = 'M' THEN 1.0 ELSE -1.0 END END) AS s1, avg(CASE WHEN hp = 2 THEN CASE WHEN parent = 'M' THEN 1.0 ELSE -1.0 END END) AS s2 FROM q GROUP BY ps)
        SELECT ps AS block, round(abs(s1 - s2) / 2, 6) AS quality FROM s WHERE s1 IS NOT NULL AND s2 IS NOT NULL""",
        "sigs",
    ),
)
def block_quality(spark, d):
    rows = phased(spark, d).where("ps is not null")
    return K.block_quality(rows.select(F.col("ps").alias("block"), "hp", F.when(F.col("qname") % 4 == 0, "M").otherwise("P").alias("parent")))


@query(
    "A30_false_positive_norm",
    sql(
        """, s AS (SELECT svtype, chrom, avg(mapq) / 62.0 AS f1, count(*) AS n FROM sigs GROUP BY ALL)
        SELECT svtype, round(sum(n * (1 - f1)), 4) AS fp FROM s GROUP BY svtype""",
        "sigs",
    ),
)
def false_positive_norm(spark, d):
    s = A.sigs(spark, d).groupBy("svtype", "chrom").agg((F.avg("mapq") / 62.0).alias("f1"), F.count("*").alias("n"))
    return s.groupBy("svtype").agg(F.round(F.sum(F.col("n") * (1 - F.col("f1"))), 4).alias("fp"))


@query(
    "A36_equal_haplotypes",
    sql(
        """, a AS (SELECT sid // 2 AS k, sid % 2 AS h, seq AS s FROM seqs)
        SELECT count(*) AS pairs, count(*) FILTER (x.s = y.s) AS same, round(avg(CASE WHEN x.s = y.s THEN 1.0 ELSE 0.0 END), 6) AS share FROM a x JOIN a y ON x.k = y.k AND x.h = 0 AND y.h = 1""",
        "seqs",
    ),
)
def equal_haplotypes(spark, d):
    s = A.sequences(spark, d).select(F.expr("sid div 2").alias("k"), (F.col("sid") % 2).alias("h"), F.col("seq").alias("s"))
    pairs = s.where("h = 0").join(s.where("h = 1").select("k", F.col("s").alias("o")), "k")
    same = F.when(F.col("s") == F.col("o"), 1.0).otherwise(0.0)
    return pairs.agg(F.count("*").alias("pairs"), F.sum(same).cast("long").alias("same"), F.round(F.avg(same), 6).alias("share"))


def split_indels_sql(ratio, low, high):
    return sql(
        NEXT
        + f""", s AS (SELECT *, (n_ref_start - ref_end) - (n_q_start - q_end) AS diff, ref_end - n_ref_start AS olap FROM adj WHERE chrom = n_chrom AND strand = n_strand AND n_ref_start >= ref_start),
        k AS (SELECT *, CASE WHEN diff >= 30 AND abs(q_end - n_q_start) <= diff * {ratio}::DOUBLE THEN 'DEL' WHEN diff <= -30 AND olap >= diff * {low}::DOUBLE AND olap <= abs(diff) * {high}::DOUBLE THEN 'INS' END AS svtype FROM s)
        SELECT qname, chrom, svtype, CASE WHEN svtype = 'DEL' THEN ref_end WHEN abs(olap) > 400 THEN (ref_end + n_ref_start) // 2 ELSE n_ref_start END AS pos, abs(diff) AS len
        FROM k WHERE svtype IS NOT NULL AND abs(diff) <= 50000""",
        "segments",
    )


@query("K4_split_indels_by_ratio", split_indels_sql(*K.SPLIT_RATIOS["CLR"]))
def split_indels_by_ratio(spark, d):
    return K.split_indels_by_ratio(A.segments(spark, d), "qname", ORDER, *K.SPLIT_RATIOS["CLR"])


@query("K4_split_indels_ont", split_indels_sql(*K.SPLIT_RATIOS["ONT"]))
def split_indels_ont(spark, d):
    return K.split_indels_by_ratio(A.segments(spark, d), "qname", ORDER, *K.SPLIT_RATIOS["ONT"])


@query("K11_inversion_evidence")
def inversion_evidence(spark, d):
    return K.inversion_evidence(numbered(spark, d), "qname", "o", gap=700)


@query("K12_translocation_clusters")
def translocation_clusters(spark, d):
    return K.translocation_clusters(numbered(spark, d), "qname", "o", gap=1000)


@query(
    "K15_finished_genotypes",
    sql(
        CALLS
        + f""", rules(dtype, svtype, lh, sh, lt, st) AS (VALUES {GT_VALUES}),
        sup AS (SELECT c.cid, sum(s.reads) AS n FROM calls c JOIN support s ON c.chrom = s.chrom AND c.svtype = s.svtype AND abs(c.pos - s.s_pos) <= greatest(500, CAST(floor(2.3 * c.svlen) AS BIGINT))
                AND s.s_len >= 0.6 * c.svlen AND s.s_len <= c.svlen / 0.6 GROUP BY c.cid),
        v AS (SELECT c.*, coalesce(n, 0)::DOUBLE / 3 AS ratio FROM calls c LEFT JOIN sup USING (cid)),
        x AS (SELECT v.*, CASE WHEN svlen > 1000 THEN lt ELSE st END AS lim FROM v JOIN rules r ON r.svtype = v.svtype AND r.dtype = 'Hifi')
        SELECT cid, round(ratio, 6) AS ratio, CASE WHEN lim IS NULL THEN '0/1' WHEN ratio > lim THEN '1/1' ELSE '0/1' END AS gt FROM x""",
        "sigs",
    ),
)
def finished_genotypes(spark, d):
    rules = spark.createDataFrame(GT_RULES, "dtype string, svtype string, lh double, sh double, lt double, st double").where("dtype = 'Hifi'")
    v = M.tolerance_support(calls(spark, d), support(spark, d), ON).withColumn("ratio", F.col("support").cast("double") / 3)
    gt = X.corrected_genotype("svlen", F.lit("0/1"), "ratio", "lh", "sh", "lt", "st")
    return v.join(F.broadcast(rules), "svtype").select("cid", F.round("ratio", 6).alias("ratio"), gt.alias("gt"))  # two rules


#: Genotypes that the calls and the drafts have of their own.
OWN = "CASE WHEN pos % 3 = 0 THEN '1/1' ELSE '0/1' END"
DRAFT = "CASE WHEN svlen % 2 = 0 THEN '1/1' ELSE '0/1' END"


@query(
    "K15_finished_calls",
    sql(
        CALLS
        + f""", rules(dtype, svtype, lh, sh, lt, st) AS (VALUES {GT_VALUES}),
        sup AS (SELECT c.cid, sum(s.reads) AS n FROM calls c JOIN support s ON c.chrom = s.chrom AND c.svtype = s.svtype AND abs(c.pos - s.s_pos) <= greatest(500, CAST(floor(2.3 * c.svlen) AS BIGINT))
                AND s.s_len >= 0.6 * c.svlen AND s.s_len <= c.svlen / 0.6 GROUP BY c.cid),
        v AS (SELECT c.*, {OWN} AS gt, coalesce(n, 0)::DOUBLE / 3 AS ratio FROM calls c LEFT JOIN sup USING (cid)),
        x AS (SELECT v.*, CASE WHEN gt = '1/1' THEN CASE WHEN svlen > 1000 THEN lh ELSE sh END ELSE CASE WHEN svlen > 1000 THEN lt ELSE st END END AS lim FROM v JOIN rules r ON r.svtype = v.svtype AND r.dtype = 'Hifi'),
        drafts AS (SELECT *, {DRAFT} AS gt FROM truth),
        m AS (SELECT c.cid, t.gt AS g, row_number() OVER (PARTITION BY c.cid ORDER BY -(least(c.svlen, t.svlen)::DOUBLE / greatest(c.svlen, t.svlen)), t.pos - c.pos, t.cid) AS k
              FROM calls c JOIN drafts t ON c.chrom = t.chrom AND c.svtype = t.svtype AND abs(c.pos - t.pos) <= 1000 AND least(c.svlen, t.svlen)::DOUBLE / greatest(c.svlen, t.svlen) >= 0.5),
        told AS (SELECT v.cid, chrom, svtype, pos, svlen, coalesce(m.g, v.gt) AS gt FROM v LEFT JOIN m ON m.cid = v.cid AND k = 1),
        l AS (SELECT c.cid, t.pos AS kp, t.svlen AS kl, row_number() OVER (PARTITION BY c.cid ORDER BY t.svlen DESC, t.cid) AS k
              FROM told c JOIN truth t ON c.chrom = t.chrom AND t.svtype = 'INS' AND abs(c.pos - t.pos) <= 200 WHERE c.svtype = 'INS'),
        ins AS (SELECT c.cid, chrom, svtype, coalesce(kp, pos) AS pos, coalesce(kl, svlen) AS svlen, gt FROM told c LEFT JOIN l ON l.cid = c.cid AND k = 1 WHERE svtype = 'INS')
        SELECT 'Hifi' AS technology, cid, chrom, svtype, pos, svlen, CASE WHEN lim IS NULL THEN gt WHEN ratio > lim THEN '1/1' ELSE '0/1' END AS gt FROM x
        UNION ALL SELECT 'CLR', * FROM told
        UNION ALL SELECT 'ONT', * FROM ins WHERE svlen BETWEEN 30 AND 50000
        UNION ALL SELECT 'ONT', * FROM told c WHERE svtype = 'DEL' AND EXISTS (SELECT 1 FROM truth t WHERE t.chrom = c.chrom AND t.svlen >= 30 AND c.pos <= t.pos + 100 AND c.pos + c.svlen >= greatest(t.pos - 99, 1))""",
        "sigs",
    ),
)
def finished_calls(spark, d):
    """The last step for each technology, from the calls' own genotypes and those of the drafts."""
    rules = spark.createDataFrame(GT_RULES, "dtype string, svtype string, lh double, sh double, lt double, st double").where("dtype = 'Hifi'").drop("dtype")
    v = M.tolerance_support(calls(spark, d), support(spark, d), ON).withColumn("ratio", F.col("support").cast("double") / 3).withColumn("gt", F.expr(OWN))
    v = v.join(F.broadcast(rules), "svtype")  # two rules
    drafts = renamed(calls(spark, d, "A"), "k_").withColumnRenamed("k_id", "kid")
    drafts = drafts.withColumn("k_gt", F.expr(DRAFT.replace("svlen", "k_len")))
    out = None
    for technology in ("Hifi", "CLR", "ONT"):
        part = K.finished_calls(v, drafts, technology).select(F.lit(technology).alias("technology"), "cid", "chrom", "svtype", "pos", "svlen", "gt")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "K14_union_of_insertions",
    sql(
        CALLS
        + """, p AS (SELECT c.cid, t.pos AS kp, t.svlen AS kl, row_number() OVER (PARTITION BY c.cid ORDER BY t.svlen DESC, t.cid) AS k
                   FROM calls c JOIN truth t ON c.chrom = t.chrom AND t.svtype = 'INS' AND abs(c.pos - t.pos) <= 200 WHERE c.svtype = 'INS'),
        i AS (SELECT c.cid, coalesce(kp, pos) AS pos, coalesce(kl, svlen) AS svlen FROM calls c LEFT JOIN p ON p.cid = c.cid AND k = 1 WHERE c.svtype = 'INS')
        SELECT cid, pos, svlen FROM i WHERE svlen BETWEEN 30 AND 50000
        UNION ALL SELECT cid, pos, svlen FROM calls c WHERE svtype = 'DEL' AND EXISTS (SELECT 1 FROM truth t WHERE t.chrom = c.chrom AND c.pos <= t.pos + t.svlen + 100 AND c.pos + c.svlen >= t.pos - 100)""",
        "sigs",
    ),
)
def union_of_insertions(spark, d):
    k = renamed(calls(spark, d, "A"), "k_").withColumnRenamed("k_id", "kid").where("svtype = 'INS'")
    ins = M.replace_by_longest(calls(spark, d).where("svtype = 'INS'"), k, ON).where("svlen between 30 and 50000")
    near = calls(spark, d, "A").select("chrom", (F.col("pos") - 100).alias("start"), (F.col("pos") + F.col("svlen") + 100).alias("end"))
    dels = calls(spark, d).where("svtype = 'DEL'").withColumn("vid", F.col("cid")).withColumn("v_start", F.col("pos")).withColumn("v_end", F.col("pos") + F.col("svlen"))
    return ins.select("cid", "pos", "svlen").unionByName(M.overlapping_rows(dels, near, ["chrom"]).select("cid", "pos", "svlen"))


@query(
    "S2_cropped_reads",
    sql("""SELECT r.rid, count(*) AS reads, CAST(sum(s.svlen) AS BIGINT) AS bases FROM regions r JOIN sigs s ON s.chrom = r.chrom AND s.pos <= r."end" AND s.pos + s.svlen >= r."start" GROUP BY r.rid""", "regions", "sigs"),
)
def cropped_reads(spark, d):
    s = A.sigs(spark, d)
    pairs = overlap_pairs(A.regions(spark, d), s, ["chrom"], F.col("start"), F.col("end"), F.col("pos"), F.col("pos") + F.col("svlen"))
    return pairs.groupBy("rid").agg(F.count("*").alias("reads"), F.sum("svlen").alias("bases"))


@query(
    "S13_renumbered_contigs",
    sql(
        """, u AS (SELECT sid, 1 AS hp, length(seq) AS n FROM seqs WHERE sid % 2 = 0 UNION ALL SELECT sid, 2, length(seq) FROM seqs WHERE sid % 2 = 1)
        SELECT sid, hp, n, row_number() OVER (PARTITION BY hp, sid % 10 ORDER BY sid) AS number FROM u""",
        "seqs",
    ),
)
def renumbered_contigs(spark, d):
    s = A.sequences(spark, d).select("sid", F.length("seq").alias("n"), (F.col("sid") % 10).alias("part"))
    parts = [s.where("sid % 2 = 0").withColumn("hp", F.lit(1)), s.where("sid % 2 = 1").withColumn("hp", F.lit(2))]
    return K.renumbered(parts, ["hp", "part"], F.col("sid")).select("sid", "hp", "n", "number")
