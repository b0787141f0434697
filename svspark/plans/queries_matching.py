"""Queries of the matching operators: calls are signatures with flag R, the truth those with flag A."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import settled
from ..operators import clustering as C
from ..operators import matching as M
from . import adapters as A
from . import query
from .adapters import sql

#: Call sets with ids that their content gives: equal calls are one.
CALLS = """, calls AS (
    SELECT chrom, svtype, pos, max(svlen) AS svlen, pos * 100 + CAST(substr(chrom, 4) AS BIGINT) * 3 + CASE WHEN svtype = 'DEL' THEN 1 ELSE 2 END AS cid
    FROM sigs WHERE flag = 'R' GROUP BY chrom, svtype, pos
), truth AS (
    SELECT chrom, svtype, pos, max(svlen) AS svlen, pos * 100 + CAST(substr(chrom, 4) AS BIGINT) * 3 + CASE WHEN svtype = 'DEL' THEN 1 ELSE 2 END AS cid
    FROM sigs WHERE flag = 'A' GROUP BY chrom, svtype, pos
), support AS (
    SELECT chrom, svtype, pos AS s_pos, svlen AS s_len, count(*) AS reads FROM sigs WHERE flag = 'N' GROUP BY chrom, svtype, pos, svlen
)
"""


def calls(spark, d, flag="R"):
    number = F.col("pos") * 100 + F.substring("chrom", 4, 2).cast("long") * 3 + F.when(F.col("svtype") == "DEL", 1).otherwise(2)
    rows = A.sigs(spark, d).where(F.col("flag") == flag).groupBy("chrom", "svtype", "pos").agg(F.max("svlen").alias("svlen"))
    return rows.withColumn("cid", number)


def support(spark, d):
    return A.sigs(spark, d).where("flag = 'N'").groupBy("chrom", "svtype", F.col("pos").alias("s_pos"), F.col("svlen").alias("s_len")).agg(
        F.count("*").alias("reads")
    )


def renamed(df, prefix):
    return df.select("chrom", "svtype", F.col("pos").alias(prefix + "pos"), F.col("svlen").alias(prefix + "len"), F.col("cid").alias(prefix + "id"))


ON = ["chrom", "svtype"]


@query(
    "J1_overlap_join",
    sql(
        CALLS
        + """SELECT c.cid, t.cid AS tid, least(c.pos + c.svlen, t.pos + t.svlen) - greatest(c.pos, t.pos) AS common
        FROM calls c JOIN truth t ON c.chrom = t.chrom AND c.pos <= t.pos + t.svlen AND t.pos <= c.pos + c.svlen""",
        "sigs",
    ),
)
def overlap_join(spark, d):
    from ..operators.intervals import overlap_pairs

    t = renamed(calls(spark, d, "A"), "t_").drop("svtype")
    c = calls(spark, d)
    pairs = overlap_pairs(c, t, ["chrom"], F.col("pos"), F.col("pos") + F.col("svlen"), F.col("t_pos"), F.col("t_pos") + F.col("t_len"), 2000)
    common = F.least(F.col("pos") + F.col("svlen"), F.col("t_pos") + F.col("t_len")) - F.greatest("pos", "t_pos")
    return pairs.select("cid", F.col("t_id").alias("tid"), common.alias("common"))


@query(
    "J1_overlap_support",
    sql(
        CALLS
        + """, p AS (SELECT c.cid, s.s_len FROM calls c JOIN support s ON c.chrom = s.chrom AND c.svtype = s.svtype
                   AND s.s_pos <= c.pos + c.svlen + 1000 AND s.s_pos + s.s_len >= c.pos - 1000)
        SELECT c.cid, count(p.cid) AS n, CAST(coalesce(sum(p.s_len), 0) AS BIGINT) AS length FROM calls c LEFT JOIN p USING (cid) GROUP BY c.cid""",
        "sigs",
    ),
)
def overlap_support(spark, d):
    c = calls(spark, d).withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + F.col("svlen"))
    s = support(spark, d).select(*ON, F.col("s_pos").alias("s_start"), (F.col("s_pos") + F.col("s_len")).alias("s_end"))
    return M.overlap_support(c, s, ON).select("cid", "n", "length")


@query(
    "J2_window_sum",
    sql(
        CALLS
        + """, p AS (SELECT c.cid, s.s_len * s.reads AS l FROM calls c JOIN support s ON c.chrom = s.chrom AND s.svtype = 'INS'
                   AND s.s_pos BETWEEN c.pos - 1000 AND c.pos + 1000 WHERE c.svtype = 'INS')
        SELECT cid, CAST(sum(l) AS BIGINT) AS length FROM p GROUP BY cid""",
        "sigs",
    ),
)
def window_sum(spark, d):
    pairs = M.within(calls(spark, d).where("svtype = 'INS'"), support(spark, d).where("svtype = 'INS'"), ON, "pos", "s_pos", 1000)
    return pairs.groupBy("cid").agg(F.sum(F.col("s_len") * F.col("reads")).alias("length"))


@query(
    "J3_tolerance_support",
    sql(
        CALLS
        + """, p AS (SELECT c.cid, s.reads FROM calls c JOIN support s ON c.chrom = s.chrom AND c.svtype = s.svtype
                   AND abs(c.pos - s.s_pos) <= greatest(500, CAST(floor(2.3 * c.svlen) AS BIGINT))
                   AND s.s_len >= 0.6 * c.svlen AND s.s_len <= c.svlen / 0.6)
        SELECT c.cid, CAST(coalesce(sum(p.reads), 0) AS BIGINT) AS support FROM calls c LEFT JOIN p USING (cid) GROUP BY c.cid""",
        "sigs",
    ),
)
def tolerance_support(spark, d):
    return M.tolerance_support(calls(spark, d), support(spark, d), ON).select("cid", "support")


@query(
    "J4_supported_calls",
    sql(
        CALLS
        + """SELECT cid FROM calls c WHERE svlen > 250 OR EXISTS (SELECT 1 FROM support s WHERE s.chrom = c.chrom
             AND abs(s.s_pos - c.pos) <= 500 AND least(s.s_len, c.svlen) >= 0.5 * greatest(s.s_len, c.svlen))""",
        "sigs",
    ),
)
def supported_calls(spark, d):
    return M.supported_calls(calls(spark, d), support(spark, d).drop("svtype"), ["chrom"]).select("cid")


READS = """, windows AS (SELECT cid AS wid, chrom, pos AS "start", pos + 20 AS "end" FROM calls),
reads AS (SELECT DISTINCT chrom, pos AS r_start, pos + svlen AS r_end, rname AS qname, CASE WHEN svtype = 'INS' THEN 1 ELSE 0 END AS forward FROM sigs)
"""


def windows(spark, d):
    return calls(spark, d).select(F.col("cid").alias("wid"), "chrom", F.col("pos").alias("start"), (F.col("pos") + 20).alias("end"))


def reads(spark, d):
    return A.sigs(spark, d).select(
        "chrom", F.col("pos").alias("r_start"), (F.col("pos") + F.col("svlen")).alias("r_end"), F.col("rname").alias("qname"),
        F.when(F.col("svtype") == "INS", 1).otherwise(0).alias("forward"),
    ).distinct()


@query(
    "J5_spanning_reads",
    sql(
        CALLS + READS
        + """SELECT w.wid, count(r.qname) AS n FROM windows w LEFT JOIN reads r ON r.chrom = w.chrom AND r.r_start < w."start" AND r.r_end > w."end" GROUP BY w.wid""",
        "sigs",
    ),
)
def spanning_reads(spark, d):
    return M.spanning_reads(windows(spark, d), reads(spark, d), ["chrom"]).select("wid", "n")


@query(
    "J6_capped_spanning",
    sql(
        CALLS + READS
        + """, k AS (SELECT w.wid, r.*, row_number() OVER (PARTITION BY w.wid ORDER BY r_start, qname, r_end, forward) AS k
                   FROM windows w JOIN reads r ON r.chrom = w.chrom AND r.r_start < w."start" AND r.r_end > w."end")
        SELECT wid, count(DISTINCT qname) AS names, CAST(sum(forward) AS BIGINT) AS forward, count(*) AS looked_at FROM k WHERE k <= 4 GROUP BY wid""",
        "sigs",
    ),
)
def capped_spanning(spark, d):
    return M.capped_spanning(windows(spark, d), reads(spark, d), ["chrom"], 4)


@query(
    "J6_counted_spanning",
    sql(
        CALLS + READS
        + """, fl AS (SELECT *, CASE WHEN r_start % 5 = 0 THEN 2048 ELSE 16 * forward END AS flag FROM reads),
        k AS (SELECT w.wid, r.*, flag IN (0, 16) AS pri, flag IN (0, 16) AND r.r_start < w."start" AND r.r_end > w."end" AS spans, CASE WHEN w.wid % 4 = 0 THEN 3 ELSE 10 * (1 + w.wid % 2) END AS cap
              FROM windows w JOIN fl r ON r.chrom = w.chrom AND r.r_start < w."end" AND r.r_end > w."start"),
        m AS (SELECT *, spans AND row_number() OVER (PARTITION BY wid, qname, spans ORDER BY r_start, r_end, flag) = 1 AS fresh FROM k),
        n AS (SELECT *, row_number() OVER o AS i, sum(CAST(fresh AS INT)) OVER o AS names, sum(CAST(pri AS INT)) OVER o AS p
              FROM m WINDOW o AS (PARTITION BY wid ORDER BY r_start, qname, r_end, flag ROWS UNBOUNDED PRECEDING)),
        t AS (SELECT *, CASE WHEN spans AND names >= cap THEN 1 WHEN pri AND i >= 8 THEN CASE WHEN p <= 0.2 * i THEN 1 ELSE -1 END END AS status FROM n),
        e AS (SELECT wid, min(i) FILTER (status IS NOT NULL) AS stop, max(i) AS last, max(names) AS every FROM t GROUP BY wid)
        SELECT w.wid, CAST(coalesce(t.names, e.every, 0) AS BIGINT) AS names, CAST(coalesce(t.status, 0) AS INT) AS status, CAST(coalesce(e.stop, e.last, 0) AS BIGINT) AS looked_at
        FROM windows w LEFT JOIN e USING (wid) LEFT JOIN t ON t.wid = e.wid AND t.i = e.stop""",
        "sigs",
    ),
)
def counted_spanning(spark, d):
    flagged = reads(spark, d).withColumn("flag", F.when(F.col("r_start") % 5 == 0, 2048).otherwise(16 * F.col("forward")))
    cap = F.when(F.col("wid") % 4 == 0, 3).otherwise(10 * (1 + F.col("wid") % 2))
    found = M.counted_spanning(windows(spark, d), flagged, ["chrom"], cap, rounds=8)
    return found.select("wid", F.col("names").cast("long"), F.col("status").cast("int"), F.col("looked_at").cast("long"))


@query("J7_haplotype_pairs")
def haplotype_pairs(spark, d):
    s = A.sigs(spark, d).select("chrom", "svtype", "pos", "svlen", "ln").distinct()
    return M.pair_haplotypes(s.where("ln % 2 = 0"), s.where("ln % 2 = 1"), ON)


@query(
    "J8_best_match_genotype",
    sql(
        CALLS
        + """, p AS (SELECT c.cid, t.svlen % 2 AS g, row_number() OVER (PARTITION BY c.cid
                   ORDER BY -(least(c.svlen, t.svlen)::DOUBLE / greatest(c.svlen, t.svlen)), t.pos - c.pos, t.cid) AS k
                   FROM calls c JOIN truth t ON c.chrom = t.chrom AND c.svtype = t.svtype AND abs(c.pos - t.pos) <= 1000
                   AND least(c.svlen, t.svlen)::DOUBLE / greatest(c.svlen, t.svlen) >= 0.5)
        SELECT c.cid, CASE WHEN g = 0 THEN '1/1' WHEN g = 1 THEN '0/1' ELSE './.' END AS gt FROM calls c LEFT JOIN p ON p.cid = c.cid AND k = 1""",
        "sigs",
    ),
)
def best_match_genotype(spark, d):
    t = renamed(calls(spark, d, "A"), "k_").withColumnRenamed("k_id", "kid")
    t = t.withColumn("k_gt", F.when(F.col("k_len") % 2 == 0, "1/1").otherwise("0/1"))
    return M.best_match(calls(spark, d).withColumn("gt", F.lit("./.")), t, ON).select("cid", "gt")


@query(
    "J9_replace_by_longest",
    sql(
        CALLS
        + """, p AS (SELECT c.cid, t.pos AS kp, t.svlen AS kl, row_number() OVER (PARTITION BY c.cid ORDER BY t.svlen DESC, t.cid) AS k
                   FROM calls c JOIN truth t ON c.chrom = t.chrom AND t.svtype = 'INS' AND abs(c.pos - t.pos) <= 200 WHERE c.svtype = 'INS')
        SELECT c.cid, coalesce(kp, pos) AS pos, coalesce(kl, svlen) AS svlen, kp IS NOT NULL AS replaced
        FROM calls c LEFT JOIN p ON p.cid = c.cid AND k = 1 WHERE c.svtype = 'INS'""",
        "sigs",
    ),
)
def replace_by_longest(spark, d):
    k = renamed(calls(spark, d, "A"), "k_").withColumnRenamed("k_id", "kid").where("svtype = 'INS'")
    return M.replace_by_longest(calls(spark, d).where("svtype = 'INS'"), k, ON).select("cid", "pos", "svlen", "replaced")


TRUTH = """, hits AS (SELECT c.cid, min(t.cid) AS tid FROM calls c JOIN truth t ON c.chrom = t.chrom AND c.svtype = t.svtype
    AND abs(c.pos - t.pos) <= 500 AND abs(c.pos + c.svlen - t.pos - t.svlen) <= 500
    AND least(c.svlen, t.svlen) >= 0.5 * greatest(c.svlen, t.svlen) GROUP BY c.cid)
"""


def matched(spark, d):
    c = calls(spark, d).withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + F.col("svlen"))
    t = calls(spark, d, "A").select(*ON, F.col("cid").alias("tid"), F.col("pos").alias("t_start"), (F.col("pos") + F.col("svlen")).alias("t_end"))
    return M.truth_match(c, t, ON)


@query("J10_truth_match", sql(CALLS + TRUTH + "SELECT c.cid, h.tid FROM calls c LEFT JOIN hits h USING (cid)", "sigs"))
def truth_match(spark, d):
    return matched(spark, d).select("cid", "tid")


@query(
    "A26_precision_recall",
    sql(
        CALLS + TRUTH
        + """, s AS (SELECT c.svtype, count(h.tid) AS called_true, count(*) AS called, count(DISTINCT h.tid) AS tp FROM calls c LEFT JOIN hits h USING (cid) GROUP BY c.svtype),
        t AS (SELECT svtype, count(*) AS truth FROM truth GROUP BY svtype)
        SELECT svtype, tp, called, truth, round(called_true::DOUBLE / called, 6) AS precision, round(tp::DOUBLE / truth, 6) AS recall FROM s JOIN t USING (svtype)""",
        "sigs",
    ),
)
def precision_recall(spark, d):
    s = matched(spark, d).groupBy("svtype").agg(F.count("tid").alias("yes"), F.count("*").alias("called"), F.count_distinct("tid").alias("tp"))
    t = calls(spark, d, "A").groupBy("svtype").agg(F.count("*").alias("truth"))
    return s.join(t, "svtype").select(
        "svtype", "tp", "called", "truth", F.round(F.col("yes") / F.col("called"), 6).alias("precision"), F.round(F.col("tp") / F.col("truth"), 6).alias("recall")
    )


#: Calls of three callers, some of them breakends.
CALLERS = """
ln % 3 AS caller;
chrom;
CASE WHEN okey % 13 = 0 THEN 'BND' ELSE svtype END AS svtype;
CASE WHEN okey % 13 = 0 THEN concat('chr', CAST(rname % 3 AS STRING)) END AS chrom2;
pos AS start;
pos + svlen * (1 + 20 * (rname % 2)) AS end;
svlen * (1 + 20 * (rname % 2)) AS svlen
"""
MERGED = (
    ", callers AS (SELECT "
    + CALLERS.strip().replace(";\n", ",\n").replace("AS STRING", "AS VARCHAR").replace("AS start", 'AS "start"').replace("AS end", 'AS "end"')
    + """ FROM sigs), k AS (
        SELECT *, coalesce(chrom2, '') AS two, CASE WHEN svtype = 'BND' THEN -1 WHEN svlen < 101 THEN 0 WHEN svlen < 501 THEN 1 WHEN svlen < 1001 THEN 2 WHEN svlen < 10000 THEN 3 ELSE 4 END AS class FROM callers
    ), g AS (SELECT *, CASE class WHEN -1 THEN 1000 WHEN 0 THEN 50 WHEN 1 THEN 101 WHEN 2 THEN 501 WHEN 3 THEN 1001 ELSE 10000 END AS gap FROM k),
    a AS (SELECT *, CASE WHEN "start" - lag("start") OVER w > gap THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY chrom, svtype, two, class ORDER BY "start")),
    b AS (SELECT * EXCLUDE new, sum(new) OVER (PARTITION BY chrom, svtype, two, class ORDER BY "start") AS c1 FROM a),
    c AS (SELECT *, CASE WHEN "end" - lag("end") OVER w > gap THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY chrom, svtype, two, class, c1 ORDER BY "end")),
    e AS (SELECT *, sum(new) OVER (PARTITION BY chrom, svtype, two, class, c1 ORDER BY "end") AS c2 FROM c),
    merged AS (
        SELECT chrom, svtype, max(chrom2) AS chrom2, CAST(class AS INTEGER) AS class, min("start") AS "start", max("end") AS "end", count(*) AS n,
               concat(max(CASE WHEN caller = 0 THEN '1' ELSE '0' END), max(CASE WHEN caller = 1 THEN '1' ELSE '0' END), max(CASE WHEN caller = 2 THEN '1' ELSE '0' END)) AS supp_vec
        FROM e GROUP BY chrom, svtype, two, class, c1, c2
    )"""
)


def merged_calls(spark, d):
    return M.merge_callsets(A.sigs(spark, d).selectExpr(*[c.strip() for c in CALLERS.strip().split(";\n")]), 3)


@query("J11_merged_callsets", sql(MERGED + "SELECT *, CAST(length(replace(supp_vec, '0', '')) AS INTEGER) AS callers FROM merged", "sigs"))
def merged_callsets(spark, d):
    return merged_calls(spark, d)


@query("J11_calls_of_one_caller", sql(MERGED + """SELECT chrom, svtype, class, count(*) AS n, min("start") AS first FROM merged WHERE supp_vec = '001' GROUP BY ALL""", "sigs"))
def calls_of_one_caller(spark, d):
    """What the last caller alone has, by the vector of support."""
    return merged_calls(spark, d).where("supp_vec = '001'").groupBy("chrom", "svtype", "class").agg(F.count("*").alias("n"), F.min("start").alias("first"))


#: Translocations of the two call sets; every other one of the truth has its ends changed over.
TRA = """
okey * 8 + ln AS id;
concat('chr', CAST(okey % 5 + 1 AS STRING)) AS chrom1;
pos AS pos1;
concat('chr', CAST(okey % 7 + 1 AS STRING)) AS chrom2;
(okey * 37) % 50000 + svlen AS pos2
"""


def translocations(spark, d, flag):
    return A.sigs(spark, d).where(F.col("flag") == flag).selectExpr(*[c.strip() for c in TRA.strip().split(";\n")])


@query(
    "J10_translocations",
    sql(
        ", x AS (SELECT flag, "
        + TRA.strip().replace(";\n", ",\n").replace("AS STRING", "AS VARCHAR")
        + """ FROM sigs), c AS (SELECT * FROM x WHERE flag = 'R'), t AS (
            SELECT id, CASE WHEN id % 2 = 0 THEN chrom1 ELSE chrom2 END AS a, CASE WHEN id % 2 = 0 THEN pos1 ELSE pos2 END AS p,
                   CASE WHEN id % 2 = 0 THEN chrom2 ELSE chrom1 END AS b, CASE WHEN id % 2 = 0 THEN pos2 ELSE pos1 END AS q FROM x WHERE flag = 'A'
        ), h AS (
            SELECT c.id AS cid, min(t.id) AS tid FROM c JOIN t
              ON (c.chrom1 = t.a AND c.chrom2 = t.b AND abs(c.pos1 - t.p) <= 1000 AND abs(c.pos2 - t.q) <= 1000)
              OR (c.chrom1 = t.b AND c.chrom2 = t.a AND abs(c.pos1 - t.q) <= 1000 AND abs(c.pos2 - t.p) <= 1000) GROUP BY c.id
        ) SELECT c.id AS cid, h.tid FROM c LEFT JOIN h ON h.cid = c.id""",
        "sigs",
    ),
)
def translocation_match(spark, d):
    c = translocations(spark, d, "R").select(F.col("id").alias("cid"), F.col("chrom1").alias("chrom"), F.col("pos1").alias("pos"), "chrom2", "pos2")
    t, even = translocations(spark, d, "A"), F.col("id") % 2 == 0
    truth = t.select(
        F.col("id").alias("tid"), F.when(even, F.col("chrom1")).otherwise(F.col("chrom2")).alias("t_chrom"), F.when(even, F.col("pos1")).otherwise(F.col("pos2")).alias("t_pos"),
        F.when(even, F.col("chrom2")).otherwise(F.col("chrom1")).alias("t_chrom2"), F.when(even, F.col("pos2")).otherwise(F.col("pos1")).alias("t_pos2"),
    )
    return M.translocation_match(c, truth).select("cid", "tid")


@query(
    "J11_somatic_calls",
    sql(
        CALLS
        + """, g AS (SELECT *, CASE WHEN svlen < 101 THEN 0 WHEN svlen < 501 THEN 1 WHEN svlen < 1001 THEN 2 WHEN svlen < 10000 THEN 3 ELSE 4 END AS k FROM calls),
        n AS (SELECT *, CASE WHEN svlen < 101 THEN 0 WHEN svlen < 501 THEN 1 WHEN svlen < 1001 THEN 2 WHEN svlen < 10000 THEN 3 ELSE 4 END AS k FROM truth)
        SELECT cid FROM g WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.chrom = g.chrom AND n.svtype = g.svtype AND n.k = g.k
            AND abs(n.pos - g.pos) <= CASE g.k WHEN 0 THEN 50 WHEN 1 THEN 101 WHEN 2 THEN 501 WHEN 3 THEN 1001 ELSE 10000 END)""",
        "sigs",
    ),
)
def somatic_calls(spark, d):
    return M.somatic(calls(spark, d), renamed(calls(spark, d, "A"), "n_"), ON).select("cid")


@query(
    "J12_similar_calls",
    sql(
        CALLS
        + """, p AS (SELECT c.cid, t.cid AS bid, least(c.svlen, t.svlen)::DOUBLE / greatest(c.svlen, t.svlen) AS score,
                   (least(c.pos + c.svlen, t.pos + t.svlen) - greatest(c.pos, t.pos))::DOUBLE / least(c.svlen, t.svlen) AS o
                   FROM calls c JOIN truth t ON c.chrom = t.chrom AND c.svtype = t.svtype AND abs(c.pos - t.pos) <= 500)
        SELECT cid, bid, round(score, 6) AS score FROM p WHERE score >= 0.5 AND o >= 0.01""",
        "sigs",
    ),
)
def similar_calls(spark, d):
    c = calls(spark, d).withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + F.col("svlen"))
    b = calls(spark, d, "A").select(*ON, F.col("cid").alias("bid"), F.col("pos").alias("b_start"), (F.col("pos") + F.col("svlen")).alias("b_end"))
    return M.similar_calls(c, b, ON).withColumn("score", F.round("score", 6))


#: The place of a call's sequence in a document's letters: as long as the call, where the document is.
PLACE = "pos % (greatest(length(seq) - svlen, 0) + 1) + 1"

#: Insertions have a sequence: a stretch of a document's letters, recoded to bases.
LINKS = f""", docs AS (SELECT count(*) AS n FROM seqs), told AS (
    SELECT c.*, CASE WHEN svtype = 'INS' THEN substr(s.seq, CAST({PLACE} AS BIGINT), svlen) END AS seq
    FROM calls c LEFT JOIN seqs s ON s.sid = (c.pos // 1000) % (SELECT n FROM docs)
), near AS (
    SELECT a.cid AS a, b.cid AS b, a.svtype, a.pos AS p, b.pos AS q, a.seq AS s, b.seq AS t, least(a.pos + a.svlen, b.pos + b.svlen) - greatest(a.pos, b.pos) AS common, least(a.svlen, b.svlen)::DOUBLE / greatest(a.svlen, b.svlen) AS alike
    FROM told a JOIN told b ON a.chrom = b.chrom AND a.svtype = b.svtype AND a.cid < b.cid AND abs(a.pos - b.pos) <= 3000
), scored AS (
    SELECT *, CASE WHEN svtype = 'INS' AND abs(p - q) <= 500 AND alike >= 0.5 THEN (length(s) + length(t) - levenshtein(s, t))::DOUBLE / nullif(length(s) + length(t), 0) END AS score FROM near
), links AS (SELECT a, b FROM scored WHERE (svtype = 'DEL' AND alike >= 0.1 AND common >= 0) OR (svtype = 'INS' AND score >= 0.5))"""


def told(spark, d):
    """Calls, insertions with their sequence."""
    seqs = A.sequences(spark, d)
    c = calls(spark, d).crossJoin(F.broadcast(seqs.agg(F.count("*").alias("docs")))).withColumn("sid", F.expr("(pos div 1000) % docs"))  # one row
    seq = F.when(F.col("svtype") == "INS", F.expr(f"substring(seq, cast({PLACE} as int), cast(svlen as int))"))
    return c.join(seqs, "sid", "left").withColumn("seq", seq).drop("sid", "docs")


def links(spark, d):
    """Links by type: deletions within 3000, of a tenth of each other's size and overlapping or touching, insertions within 500, half and alike."""
    found = M.match_links(calls(spark, d).where("svtype = 'DEL'"), ON, 3000, 0.1, overlap=0)
    return found.unionByName(M.match_links(told(spark, d).where("svtype = 'INS'"), ON, 500, 0.5, 0.5))


@query("J18_match_links", sql(CALLS + LINKS + "SELECT a, b FROM links", "sigs", "seqs"))
def match_links(spark, d):
    return links(spark, d)


@query(
    "A16_components_best_pick",
    sql(
        CALLS.replace(", calls AS", ", calls AS", 1) + LINKS
        + """, both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        walk(node, root) AS (SELECT cid, cid FROM calls UNION SELECT e.b, w.root FROM walk w JOIN both_ways e ON e.a = w.node WHERE e.b > w.root OR w.root < e.b),
        comp AS (SELECT node AS cid, min(root) AS component FROM walk GROUP BY node)
        SELECT component, count(*) AS n, arg_max(cid, svlen * 1000000000000 - cid) AS cid FROM comp JOIN calls USING (cid) GROUP BY component""",
        "sigs", "seqs",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def components_best_pick(spark, d):
    c = calls(spark, d)
    groups = C.connected_components(links(spark, d)).withColumnRenamed("node", "cid")
    rows = c.join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    return rows.groupBy("component").agg(F.count("*").alias("n"), F.max_by("cid", F.col("svlen") * 1000000000000 - F.col("cid")).alias("cid"))


#: Both call sets with a sequence each, on every fifth place repeats of one base; the regions that count.
WITH_SEQUENCES = f""", docs AS (SELECT count(*) AS n FROM seqs), both_sets AS (SELECT 'R' AS flag, * FROM calls UNION ALL SELECT 'A', * FROM truth), spelled AS (
    SELECT c.*, CASE WHEN pos % 5 = 0 THEN repeat(substr('ACGT', CAST(svlen % 4 AS BIGINT) + 1, 1), svlen) ELSE substr(s.seq, CAST({PLACE} AS BIGINT), svlen) END AS seq
    FROM both_sets c LEFT JOIN seqs s ON s.sid = (c.pos // 1000) % (SELECT n FROM docs)
)"""


def spelled(spark, d, flag):
    """Calls with a sequence each: cid, chrom, svtype, start, end, seq."""
    seqs = A.sequences(spark, d)
    c = calls(spark, d, flag).crossJoin(F.broadcast(seqs.agg(F.count("*").alias("docs")))).withColumn("sid", F.expr("(pos div 1000) % docs"))  # one row
    seq = F.expr(f"CASE WHEN pos % 5 = 0 THEN repeat(substring('ACGT', cast(svlen % 4 as int) + 1, 1), cast(svlen as int)) ELSE substring(seq, cast({PLACE} as int), cast(svlen as int)) END")
    return c.join(seqs, "sid", "left").select("cid", *ON, F.col("pos").alias("start"), (F.col("pos") + F.col("svlen")).alias("end"), seq.alias("seq"))


def benchmark_rows(spark, d):
    t = spelled(spark, d, "A")
    return t.select(*ON, F.col("cid").alias("bid"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("seq").alias("b_seq"))


@query(
    "J12_alike_calls",
    sql(
        CALLS + WITH_SEQUENCES
        + """, p AS (SELECT c.cid, t.cid AS bid, c.seq AS s, t.seq AS t, least(c.svlen, t.svlen)::DOUBLE / greatest(c.svlen, t.svlen) AS z,
                   (least(c.pos + c.svlen, t.pos + t.svlen) - greatest(c.pos, t.pos))::DOUBLE AS common, least(c.svlen, t.svlen) AS low, greatest(c.svlen, t.svlen) AS high
                   FROM spelled c JOIN spelled t ON c.flag = 'R' AND t.flag = 'A' AND c.chrom = t.chrom AND c.svtype = t.svtype AND abs(c.pos - t.pos) <= 500 WHERE c.svlen >= 30 AND t.svlen >= 50),
        q AS (SELECT *, CASE WHEN z >= 0.5 AND common / low >= 0.01 THEN (length(s) + length(t) - levenshtein(s, t))::DOUBLE / nullif(length(s) + length(t), 0) END AS w FROM p)
        SELECT cid, bid, round((w + z + common / high) / 3, 6) AS score FROM q WHERE w >= 0.5""",
        "sigs", "seqs",
    ),
)
def alike_calls(spark, d):
    """Benchmark matches that are alike in sequence too; repeats of unlike bases fail."""
    return M.alike_calls(spelled(spark, d, "R"), benchmark_rows(spark, d), ON).withColumn("score", F.round("score", 6))


@query("J12_benchmark")
def benchmark(spark, d):
    """Calls and benchmark inside the regions, matched one to one: what has no mate is a false positive or negative."""
    found = M.benchmark(spelled(spark, d, "R"), benchmark_rows(spark, d), ON, A.regions(spark, d))
    return found.withColumn("score", F.round("score", 6))


@query(
    "J21_points_in_regions",
    sql(
        """SELECT r.rid, count(s.pos) AS n FROM regions r LEFT JOIN sigs s ON s.chrom = r.chrom AND s.svtype = 'INS'
           AND s.pos BETWEEN r."start" AND r."end" GROUP BY r.rid""",
        "sigs", "regions",
    ),
)
def points_in_regions(spark, d):
    points = A.sigs(spark, d).where("svtype = 'INS'").select("chrom", "pos")
    return M.regions_of_points(A.regions(spark, d), points, ["chrom"]).select("rid", "n")


@query(
    "P5_calls_in_regions",
    sql(CALLS + """SELECT cid FROM calls c WHERE EXISTS (SELECT 1 FROM regions r WHERE r.chrom = c.chrom AND c.pos <= r."end" AND c.pos + c.svlen >= r."start")""", "sigs", "regions"),
)
def calls_in_regions(spark, d):
    c = calls(spark, d).select("chrom", F.col("cid").alias("vid"), F.col("pos").alias("v_start"), (F.col("pos") + F.col("svlen")).alias("v_end"))
    return M.overlapping_rows(c, A.regions(spark, d), ["chrom"]).select(F.col("vid").alias("cid"))


@query(
    "J14_shared_read_names",
    sql("SELECT DISTINCT a.qname FROM segments a JOIN segments b ON a.qname = b.qname WHERE a.chrom = 'chr1' AND b.chrom = 'chr2'", "segments"),
)
def shared_read_names(spark, d):
    s = A.segments(spark, d)
    return s.where("chrom = 'chr1'").select("qname").intersect(s.where("chrom = 'chr2'").select("qname"))


@query(
    "F2_sequence_links",
    sql(CALLS + LINKS + "SELECT a, b, round(score, 6) AS score FROM scored WHERE score IS NOT NULL", "sigs", "seqs"),
)
def sequence_links(spark, d):
    c = told(spark, d).where("svtype = 'INS'")
    pairs = settled(M.match_links(c, ON, 500, 0.5))
    pairs = M.with_texts(M.with_texts(pairs, c, {"a": "cid"}, "seq", "seq"), c, {"b": "cid"}, "seq", "o")
    scored = M.compared(pairs, ["a", "b"], "seq", "o", "score")
    return scored.where("score is not null").withColumn("score", F.round("score", 6))
