"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import phasing as P
from ..operators.intervals import islands
from . import adapters as A
from . import query
from .adapters import sql
from .queries_matching import CALLS, TRUTH, calls, matched

BIN = " + ".join(f"CASE WHEN svlen >= {c} THEN 1 ELSE 0 END" for c in E.SIZE_CUTS)


@query(
    "A25_confusion_by_size",
    sql(
        CALLS + TRUTH
        + f""", o AS (SELECT svtype, svlen, CASE WHEN tid IS NULL THEN 'FP' ELSE 'TP' END AS k FROM calls LEFT JOIN hits USING (cid)
            UNION ALL SELECT svtype, svlen, 'FN' FROM truth WHERE cid NOT IN (SELECT tid FROM hits)),
        s AS (SELECT svtype, {BIN} AS bin, count(*) FILTER (k = 'TP') AS tp, count(*) FILTER (k = 'FP') AS fp, count(*) FILTER (k = 'FN') AS fn FROM o GROUP BY ALL)
        SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall,
               round(CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0 THEN 2.0 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)) END, 6) AS f1 FROM s""",
        "sigs",
    ),
)
def confusion_by_size(spark, d):
    found = matched(spark, d)
    missed = calls(spark, d, "A").join(found.select(F.col("tid").alias("cid")).where("cid is not null").distinct(), "cid", "left_anti")
    rows = found.select("svtype", "svlen", F.when(F.col("tid").isNull(), "FP").otherwise("TP").alias("outcome")).unionByName(
        missed.select("svtype", "svlen", F.lit("FN").alias("outcome"))
    )
    return E.confusion_by_size(rows)


MEMBERS = """, marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 1800 THEN 0 ELSE 1 END AS new FROM points),
members AS (SELECT *, CAST(sum(new) OVER (PARTITION BY chrom ORDER BY pos, new DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cid FROM marked)
"""


def members(spark, d):
    return islands(A.points(spark, d), ["chrom"], "pos", 1800)


@query(
    "A28_consensus_sweep",
    sql(
        MEMBERS
        + """, votes AS (SELECT DISTINCT chrom, cid, tool FROM members), sup AS (SELECT chrom, cid, count(*) AS support FROM votes GROUP BY ALL),
        ks AS (SELECT unnest([2, 3, 4, 5]) AS k), bench AS (SELECT k, count(*) AS bench FROM sup JOIN ks ON support >= k GROUP BY k),
        called AS (SELECT tool, count(*) AS called FROM votes GROUP BY tool),
        found AS (SELECT k, tool, count(*) AS found FROM votes JOIN sup USING (chrom, cid) JOIN ks ON support >= k GROUP BY ALL)
        SELECT k, tool, bench, found, round(found::DOUBLE / bench, 6) AS recall, round(found::DOUBLE / called, 6) AS precision
        FROM found JOIN bench USING (k) JOIN called USING (tool)""",
        "points",
    ),
)
def consensus_sweep(spark, d):
    return E.consensus_sweep(members(spark, d), ["chrom", "cid"], "tool", 5)


@query(
    "A27_majority_vote",
    sql(
        MEMBERS
        + """, c AS (SELECT chrom, cid, tool, count(*) AS n FROM members GROUP BY ALL), m AS (SELECT chrom, cid, max(n) AS n FROM c GROUP BY ALL)
        SELECT chrom, cid, CASE WHEN count(*) = 1 THEN min(tool) ELSE './.' END AS tool, max(n) AS n FROM c JOIN m USING (chrom, cid, n) GROUP BY chrom, cid""",
        "points",
    ),
)
def majority_vote(spark, d):
    return E.majority_vote(members(spark, d), ["chrom", "cid"], "tool")


@query(
    "A35_n50",
    sql(
        MEMBERS
        + """, b AS (SELECT chrom, cid, max(pos) - min(pos) + 1 AS len FROM members GROUP BY ALL),
        r AS (SELECT chrom, len, sum(len) OVER (PARTITION BY chrom ORDER BY len DESC) AS run, sum(len) OVER (PARTITION BY chrom) AS total FROM b)
        SELECT chrom, max(len) AS n50 FROM r WHERE run >= 0.5 * total GROUP BY chrom""",
        "points",
    ),
)
def n50(spark, d):
    blocks = members(spark, d).groupBy("chrom", "cid").agg((F.max("pos") - F.min("pos") + 1).alias("len"))
    return E.n50(blocks, ["chrom"], "len")


@query(
    "A22_strand_ratio",
    sql(
        """SELECT chrom, count(*) FILTER (strand = '-') AS w, count(*) FILTER (strand = '+') AS c,
        round((count(*) FILTER (strand = '+') - count(*) FILTER (strand = '-'))::DOUBLE / count(*), 6) AS ratio FROM segments WHERE mapq >= 20 GROUP BY chrom""",
        "segments",
    ),
)
def strand_ratio(spark, d):
    return E.strand_ratio(A.segments(spark, d).where("mapq >= 20"), ["chrom"])


SNPS = """, snps AS (SELECT chrom, pos, max(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS phase FROM points GROUP BY chrom, pos),
sw AS (SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY chrom ORDER BY pos) <> phase THEN 1 ELSE 0 END AS switch FROM snps)
"""


def snps(spark, d):
    return A.points(spark, d).groupBy("chrom", "pos").agg(F.max(F.when(F.col("value") > 50, 1).otherwise(0)).alias("phase"))


@query(
    "W11_switch_errors",
    sql(
        SNPS
        + """, k AS (SELECT *, coalesce(lag(switch) OVER w, 0) + coalesce(lead(switch) OVER w, 0) > 0 AS near FROM sw WINDOW w AS (PARTITION BY chrom ORDER BY pos))
        SELECT chrom, CASE WHEN switch = 0 THEN 'CORRECT' WHEN near THEN 'POINT' ELSE 'LONG' END AS kind, count(*) AS n FROM k GROUP BY ALL""",
        "points",
    ),
)
def switch_errors(spark, d):
    return E.switch_flags(snps(spark, d), ["chrom"], "pos", "phase").groupBy("chrom", "kind").agg(F.count("*").alias("n"))


@query(
    "W13_blocks_between_errors",
    sql(SNPS + """, p AS (SELECT *, sum(switch) OVER (PARTITION BY chrom ORDER BY pos) AS piece FROM sw) SELECT chrom, CAST(piece AS BIGINT) AS piece, min(pos) AS "start", max(pos) AS "end", count(*) AS n FROM p GROUP BY chrom, piece""", "points"),
)
def blocks_between_errors(spark, d):
    rows = E.switch_flags(snps(spark, d), ["chrom"], "pos", "phase")
    return E.blocks_between_errors(rows, ["chrom"], "pos").withColumn("piece", F.col("piece").cast("long"))


def blocks_of_snps(spark, d):
    """SNPs in phase blocks of a week; every eleventh position isn't phased."""
    return snps(spark, d).withColumn("ps", F.expr("pos div 604800")).withColumn("phase", F.when(F.col("pos") % 11 != 0, F.col("phase")))


@query("K17_switch_kinds")
def switch_kinds(spark, d):
    errors = P.phase_errors(blocks_of_snps(spark, d), ["chrom", "ps"], "pos", "phase")
    return errors.groupBy("chrom", "error").agg(F.count("*").alias("n"))


@query(
    "K17_switch_rate",
    sql(
        """, snps AS (SELECT chrom, pos, pos // 604800 AS ps, max(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS phase FROM points GROUP BY chrom, pos),
        w AS (SELECT chrom, phase, lag(phase) OVER (PARTITION BY chrom, ps ORDER BY pos) AS p FROM snps WHERE pos % 11 <> 0)
        SELECT chrom, count(p) AS measured, count(*) FILTER (p <> phase) AS switches, round(100.0 * count(*) FILTER (p <> phase) / nullif(count(p), 0), 6) AS rate FROM w GROUP BY chrom""",
        "points",
    ),
)
def switch_rate(spark, d):
    return P.switch_rate(P.phase_errors(blocks_of_snps(spark, d), ["chrom", "ps"], "pos", "phase"), ["chrom"])


@query(
    "K17_adjusted_blocks",
    sql(
        """, snps AS (SELECT chrom, pos, pos // 604800 AS ps FROM points GROUP BY chrom, pos),
        b AS (SELECT chrom, ps, min(pos) AS low, max(pos) AS high FROM snps WHERE pos % 11 <> 0 GROUP BY chrom, ps),
        t AS (SELECT b.chrom, b.ps, low, high, count(*) AS total, count(*) FILTER (s.pos % 11 <> 0 AND s.ps = b.ps) AS phased
              FROM b JOIN snps s ON s.chrom = b.chrom AND s.pos > low AND s.pos <= high GROUP BY ALL)
        SELECT chrom, ps, CAST(0 AS BIGINT) AS part, total, phased, high - low + 1 AS length, round((high - low + 1) * phased / total, 4) AS adjusted FROM t WHERE phased > 0""",
        "points",
    ),
)
def adjusted_blocks(spark, d):
    s = blocks_of_snps(spark, d)
    return P.adjusted_blocks(s, P.phase_errors(s, ["chrom", "ps"], "pos", "phase"))


@query("K17_blocks_between_errors")
def adjusted_parts(spark, d):
    s = blocks_of_snps(spark, d)
    return P.adjusted_blocks(s, P.phase_errors(s, ["chrom", "ps"], "pos", "phase"), cut=True)


def block_n50s(blocks):
    """N50 of the lengths and of the adjusted lengths of a chromosome's blocks."""
    plain, adjusted = E.n50(blocks, ["chrom"], "length"), E.n50(blocks, ["chrom"], "adjusted")
    return plain.join(adjusted.withColumnRenamed("n50", "adjusted_n50"), "chrom")


@query(
    "K17_an50",
    sql(
        """, snps AS (SELECT chrom, pos, pos // 604800 AS ps FROM points GROUP BY chrom, pos),
        b AS (SELECT chrom, ps, min(pos) AS low, max(pos) AS high FROM snps WHERE pos % 11 <> 0 GROUP BY chrom, ps),
        t AS (SELECT b.chrom, b.ps, low, high, count(*) AS total, count(*) FILTER (s.pos % 11 <> 0 AND s.ps = b.ps) AS phased
              FROM b JOIN snps s ON s.chrom = b.chrom AND s.pos > low AND s.pos <= high GROUP BY ALL),
        a AS (SELECT chrom, high - low + 1 AS length, round((high - low + 1) * phased / total, 4) AS adjusted FROM t WHERE phased > 0),
        r AS (SELECT chrom, length, adjusted, sum(length) OVER (PARTITION BY chrom ORDER BY length DESC) AS rl, sum(adjusted) OVER (PARTITION BY chrom ORDER BY adjusted DESC) AS ra,
                     sum(length) OVER (PARTITION BY chrom) AS al, sum(adjusted) OVER (PARTITION BY chrom) AS aa FROM a)
        SELECT chrom, max(length) FILTER (rl >= 0.5 * al) AS n50, max(adjusted) FILTER (ra >= 0.5 * aa) AS adjusted_n50 FROM r GROUP BY chrom""",
        "points",
    ),
)
def an50(spark, d):
    return block_n50s(adjusted_blocks(spark, d))


@query("K17_qan50")
def qan50(spark, d):
    """The same of blocks that are parted at switches."""
    return block_n50s(adjusted_parts(spark, d))


@query(
    "A38_pairs_by_distance",
    sql(
        SNPS
        + """, p AS (SELECT (b.pos - a.pos - 1) // 3600 AS bin, CASE WHEN a.phase = b.phase THEN 1 ELSE 0 END AS ok FROM snps a JOIN snps b ON a.chrom = b.chrom AND b.pos > a.pos AND b.pos - a.pos <= 36000),
        s AS (SELECT bin, count(*) AS pairs, CAST(sum(ok) AS BIGINT) AS accurate FROM p GROUP BY bin)
        SELECT bin, pairs, accurate, CAST(sum(pairs) OVER (ORDER BY bin) AS BIGINT) AS cumulative FROM s""",
        "points",
    ),
)
def pairs_by_distance(spark, d):
    return E.pairs_by_distance(snps(spark, d), ["chrom"], "pos", "phase", 36000, 3600)


@query("A31_length_quantiles", sql("SELECT svtype, unnest(quantile_cont(svlen, [0.0, 0.1, 0.5, 0.9])) AS q, count(*) AS n, max(svlen) AS top FROM sigs GROUP BY svtype", "sigs"))
def length_quantiles(spark, d):
    rows = A.sigs(spark, d).select("svtype", "svlen")
    top = rows.groupBy("svtype").agg(F.max("svlen").alias("top"))
    return E.exact_quantiles(rows, ["svtype"], "svlen", [0.0, 0.1, 0.5, 0.9]).join(top, "svtype").select("svtype", "q", "n", "top")


@query("A32_length_histogram", sql("SELECT svtype, svlen // 100 AS bin, count(*) AS n FROM sigs GROUP BY ALL", "sigs"))
def length_histogram(spark, d):
    return A.sigs(spark, d).groupBy("svtype", F.expr("svlen div 100").alias("bin")).agg(F.count("*").alias("n"))


@query("A24_tagged_share", sql("SELECT chrom, round(100.0 * count(*) FILTER (flag <> 'N') / count(*), 6) AS share, count(DISTINCT flag) AS tags FROM sigs GROUP BY chrom", "sigs"))
def tagged_share(spark, d):
    return A.sigs(spark, d).groupBy("chrom").agg(
        F.round(100 * F.avg(F.when(F.col("flag") != "N", 1).otherwise(0)), 6).alias("share"), F.count_distinct("flag").alias("tags")
    )


@query(
    "A29_parameter_grid",
    sql(
        CALLS
        + """, p AS (SELECT c.cid, c.svtype, abs(c.pos - t.pos) AS d, least(c.svlen, t.svlen)::DOUBLE / greatest(c.svlen, t.svlen) AS s
                   FROM calls c JOIN truth t ON c.chrom = t.chrom AND c.svtype = t.svtype AND abs(c.pos - t.pos) <= 1000)
        SELECT svtype, r, q / 10.0 AS similarity, count(DISTINCT cid) AS found FROM p, (SELECT unnest(generate_series(0, 1000, 100)) AS r), (SELECT unnest(generate_series(0, 10)) AS q)
        WHERE d <= r AND s >= q / 10.0 GROUP BY ALL""",
        "sigs",
    ),
)
def parameter_grid(spark, d):
    from ..functions.scalars import size_similarity
    from ..operators.matching import within
    from .queries_matching import ON, renamed

    pairs = within(calls(spark, d), renamed(calls(spark, d, "A"), "t_"), ON, "pos", "t_pos", 1000)
    pairs = pairs.select("cid", "svtype", F.abs(F.col("pos") - F.col("t_pos")).alias("d"), size_similarity("svlen", "t_len").alias("s"))
    # each pair counts at every wider distance and every laxer similarity of the grid
    r = F.explode(F.sequence(F.ceil(F.col("d") / 100) * 100, F.lit(1000), F.lit(100)))
    q = F.explode(F.filter(F.sequence(F.lit(0), F.lit(10)), lambda x: F.col("s") >= x / 10.0))
    grid = pairs.withColumn("r", r).withColumn("q", q).select("cid", "svtype", "r", "q").distinct()
    return grid.groupBy("svtype", "r", (F.col("q") / 10.0).alias("similarity")).agg(F.count("*").alias("found"))


@query(
    "J16_tool_summary",
    sql("SELECT chrom, count(*) FILTER (tool = 'view') AS view, count(*) FILTER (tool = 'click') AS click, count(*) FILTER (tool = 'error') AS error FROM points GROUP BY chrom", "points"),
)
def tool_summary(spark, d):
    return A.points(spark, d).groupBy("chrom").pivot("tool", ["view", "click", "error"]).agg(F.count(F.lit(1))).na.fill(0)
