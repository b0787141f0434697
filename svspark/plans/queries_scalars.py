"""Queries of filters, scalar functions, sorts, set operations and round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..lineage import settled, shared_folder
from ..operators import evaluation as E
from ..sources import reference as R
from ..sources import tables as T
from . import adapters as A
from . import query
from .adapters import sql
from .queries_matching import CALLS, calls


@query("P1_autosomes", sql("SELECT chrom, count(*) AS n FROM sigs WHERE regexp_matches(chrom, '^chr([1-9]|1[0-9]|2[0-2])$') AND svlen > 30 GROUP BY chrom", "sigs"))
def autosomes(spark, d):
    return A.sigs(spark, d).where(X.is_autosome("chrom") & (F.col("svlen") > 30)).groupBy("chrom").agg(F.count("*").alias("n"))


@query(
    "P3_length_types",
    sql(
        """, v AS (SELECT chrom, pos, CASE WHEN svtype = 'DEL' THEN repeat('A', svlen) ELSE 'A' END AS ref, CASE WHEN svtype = 'DEL' THEN 'A' ELSE repeat('C', svlen) END AS alt FROM sigs)
        SELECT CASE WHEN length(alt) - length(ref) >= 50 THEN 'INS' WHEN length(alt) - length(ref) <= -50 THEN 'DEL' END AS kind, count(*) AS n FROM v GROUP BY ALL""",
        "sigs",
    ),
)
def length_types(spark, d):
    is_del = F.col("svtype") == "DEL"
    long = lambda base: F.repeat(F.lit(base), F.col("svlen").cast("int"))
    v = A.sigs(spark, d).select(F.when(is_del, long("A")).otherwise(F.lit("A")).alias("ref"), F.when(is_del, F.lit("A")).otherwise(long("C")).alias("alt"))
    return v.groupBy(X.length_type("ref", "alt").alias("kind")).agg(F.count("*").alias("n"))


@query(
    "P6_duplication_filter",
    sql(
        """, c AS (SELECT chrom, okey, count(*) AS n_sup, avg(mapq) AS mapq, max(svlen) AS size FROM sigs GROUP BY chrom, okey)
        SELECT chrom, okey, n_sup, round(mapq, 4) AS mapq, size FROM c WHERE n_sup >= 10 * 0.1 AND mapq >= 50 AND size >= 200""",
        "sigs",
    ),
)
def duplication_filter(spark, d):
    c = A.sigs(spark, d).groupBy("chrom", "okey").agg(F.count("*").alias("n_sup"), F.avg("mapq").alias("mapq"), F.max("svlen").alias("size"))
    return c.where((F.col("n_sup") >= 10 * 0.1) & (F.col("mapq") >= 50) & (F.col("size") >= 200)).withColumn("mapq", F.round("mapq", 4))


#: Thresholds of the first filter of duplications, inversions and translocations by technology.
FIRST_FILTERS = [
    ("HIFI", "DUP", 0.1, 50.0, 200, 10**12), ("CLR", "DUP", 0.14, 50.0, 500, 10**12), ("ONT", "DUP", 0.1, 40.0, 500, 10**12),
    ("HIFI", "INV", 0.25, 60.0, 200, 160_000_000), ("CLR", "INV", 0.3, 58.0, 1000, 160_000_000), ("ONT", "INV", 0.35, 58.0, 1000, 160_000_000),
    ("HIFI", "TRA", 0.1, 55.0, 0, 10**12), ("CLR", "TRA", 0.15, 57.0, 0, 10**12), ("ONT", "TRA", 0.2, 55.0, 0, 10**12),
]
RULES = ", ".join(str(r) for r in FIRST_FILTERS)


@query(
    "P6_P8_P9_first_filters",
    sql(
        f""", rules(dtype, kind, share, mapq, low, high) AS (VALUES {RULES}),
        c AS (SELECT chrom, pos // 1000 AS place, count(*) AS n_sup, avg(mapq) AS mapq, max(svlen) AS size FROM sigs GROUP BY ALL)
        SELECT r.dtype, r.kind, count(*) AS passed FROM c JOIN rules r ON c.n_sup >= r.share * 8 AND c.mapq >= r.mapq AND c.size BETWEEN r.low AND r.high GROUP BY ALL""",
        "sigs",
    ),
)
def first_filters(spark, d):
    c = A.sigs(spark, d).groupBy("chrom", F.expr("pos div 1000").alias("place")).agg(F.count("*").alias("n_sup"), F.avg("mapq").alias("m"), F.max("svlen").alias("size"))
    rules = spark.createDataFrame(FIRST_FILTERS, "dtype string, kind string, share double, mapq double, low long, high long")
    hit = (F.col("n_sup") >= F.col("share") * 8) & (F.col("m") >= F.col("mapq")) & F.col("size").between(F.col("low"), F.col("high"))
    return c.join(F.broadcast(rules), hit).groupBy("dtype", "kind").agg(F.count("*").alias("passed"))  # nine rules


@query(
    "P11_quantile_band",
    sql(
        """, m AS (SELECT svtype, quantile_cont(svlen, 0.5) AS m FROM sigs GROUP BY svtype)
        SELECT svtype, count(*) AS n, min(svlen) AS low, max(svlen) AS high FROM sigs JOIN m USING (svtype) WHERE svlen BETWEEN 0.2 * m AND 1.6 * m GROUP BY svtype""",
        "sigs",
    ),
)
def quantile_band(spark, d):
    rows = E.quantile_band(A.sigs(spark, d), ["svtype"], "svlen", 0.2, 1.6)
    return rows.groupBy("svtype").agg(F.count("*").alias("n"), F.min("svlen").alias("low"), F.max("svlen").alias("high"))


@query(
    "P13_flag_classes",
    sql(
        """, f AS (SELECT CASE rname % 5 WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 2048 WHEN 3 THEN 2064 ELSE 256 END AS bits, mapq FROM sigs)
        SELECT CASE bits WHEN 0 THEN 1 WHEN 16 THEN 2 WHEN 2048 THEN 3 WHEN 2064 THEN 4 ELSE 0 END AS cls, count(*) AS n FROM f WHERE mapq >= 30 GROUP BY ALL""",
        "sigs",
    ),
)
def flag_classes(spark, d):
    bits = F.element_at(F.array(*[F.lit(x) for x in (0, 16, 2048, 2064, 256)]), (F.col("rname") % 5 + 1).cast("int"))
    return A.sigs(spark, d).where("mapq >= 30").groupBy(X.flag_class(bits).alias("cls")).agg(F.count("*").alias("n"))


@query(
    "P15_region_names",
    sql("""SELECT rid, concat('Region_', chrom, '_S', "start" - 100000, '_E', "end") AS name, chrom, greatest("start" - 100000, 0) AS "start", "end" FROM regions""", "regions"),
)
def region_names(spark, d):
    rows = A.regions(spark, d).select("rid", X.region_name("chrom", F.col("start") - 100000, "end").alias("name"))
    return rows.select("rid", "name", X.parse_region("name").alias("r")).select("rid", "name", "r.*")


@query("P16_flanked_regions", sql(CALLS + """SELECT cid, greatest(pos - 50000, 0) AS "start", pos + CASE WHEN svtype = 'DEL' THEN svlen ELSE 0 END + 50000 AS "end" FROM calls""", "sigs"))
def flanked_regions(spark, d):
    reach = F.when(F.col("svtype") == "DEL", F.col("svlen")).otherwise(0)
    return calls(spark, d).select("cid", F.greatest(F.col("pos") - 50000, F.lit(0)).alias("start"), (F.col("pos") + reach + 50000).alias("end"))


GENOTYPE = """SELECT r, a, CASE WHEN n0 = greatest(n0, n1, n2) THEN '0/0' WHEN n1 = greatest(n0, n1, n2) THEN '0/1' ELSE '1/1' END AS gt,
    CAST(round_even(-10 * n0, 0) AS INTEGER) AS pl0, CAST(round_even(-10 * n1, 0) AS INTEGER) AS pl1, CAST(round_even(-10 * n2, 0) AS INTEGER) AS pl2, n FROM (
    SELECT r, a, n, l0 - s AS n0, l1 - s AS n1, l2 - s AS n2 FROM (
    SELECT *, greatest(l0, l1, l2) + log10(power(10, l0 - greatest(l0, l1, l2)) + power(10, l1 - greatest(l0, l1, l2)) + power(10, l2 - greatest(l0, l1, l2))) AS s FROM (
    SELECT r, a, n, log10(0.9) * r0 + log10(0.1) * a0 + log10((1 - 1.0 / 3) / 2) AS l0, log10(0.5) * (r0 + a0) + log10(1.0 / 3) AS l1,
           log10(0.1) * r0 + log10(0.9) * a0 + log10((1 - 1.0 / 3) / 2) AS l2 FROM counts)))"""


@query(
    "F13_genotypes",
    sql(
        """, c AS (SELECT l_suppkey AS r0_, CAST(l_quantity AS BIGINT) AS a0_ FROM lineitem),
        d AS (SELECT r0_ % 130 AS r, a0_ AS a, count(*) AS n FROM c GROUP BY ALL),
        counts AS (SELECT r, a, n, CASE WHEN r + a > 100 THEN floor(100.0 * r / (r + a)) ELSE r END AS r0,
                          CASE WHEN r + a > 100 THEN 100 - floor(100.0 * r / (r + a)) ELSE a END AS a0 FROM d)
        """.replace(", c AS", "WITH c AS", 1)
        + GENOTYPE
    ),
)
def genotypes(spark, d):
    rows = A.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 130).alias("r"), F.col("l_quantity").cast("long").alias("a")).agg(F.count("*").alias("n"))
    g = rows.withColumn("g", X.genotype("r", "a"))
    return g.select("r", "a", "n", "g.gt", F.col("g.pl")[0].alias("pl0"), F.col("g.pl")[1].alias("pl1"), F.col("g.pl")[2].alias("pl2"))


#: Thresholds of genotype correction, null where a rule is off: large 1/1, small 1/1, large 0/1, small 0/1.
GT_RULES = [
    ("Hifi", "DEL", 0.6, 0.69, 0.71, 0.91), ("Hifi", "INS", None, 0.59, 0.63, 0.79), ("CLR", "DEL", 0.55, 0.59, 0.65, 0.75),
    ("CLR", "INS", None, None, 0.64, 0.75), ("ONT", "DEL", 0.61, 0.61, 0.68, 0.79), ("ONT", "INS", None, None, 0.67, 0.72),
]
GT_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in GT_RULES)


@query(
    "F16_corrected_genotypes",
    sql(
        f""", rules(dtype, svtype, lh, sh, lt, st) AS (VALUES {GT_VALUES}),
        v AS (SELECT svtype, svlen, CASE WHEN rname % 2 = 0 THEN '1/1' ELSE '0/1' END AS gt, CAST(rname % 11 AS DOUBLE) / nullif(rname % 13, 0) AS ratio FROM sigs),
        x AS (SELECT v.*, r.dtype, CASE WHEN gt = '1/1' THEN CASE WHEN svlen > 1000 THEN lh ELSE sh END ELSE CASE WHEN svlen > 1000 THEN lt ELSE st END END AS lim
              FROM v JOIN rules r USING (svtype))
        SELECT dtype, svtype, gt, CASE WHEN lim IS NULL OR ratio IS NULL THEN gt WHEN ratio > lim THEN '1/1' ELSE '0/1' END AS new_gt, count(*) AS n FROM x GROUP BY ALL""",
        "sigs",
    ),
)
def corrected_genotypes(spark, d):
    rules = spark.createDataFrame(GT_RULES, "dtype string, svtype string, lh double, sh double, lt double, st double")
    v = A.sigs(spark, d).select(
        "svtype", "svlen", F.when(F.col("rname") % 2 == 0, "1/1").otherwise("0/1").alias("gt"),
        F.try_divide((F.col("rname") % 11).cast("double"), (F.col("rname") % 13).cast("double")).alias("ratio"),
    )
    new = X.corrected_genotype("svlen", "gt", "ratio", "lh", "sh", "lt", "st")
    return v.join(F.broadcast(rules), "svtype").groupBy("dtype", "svtype", "gt", new.alias("new_gt")).agg(F.count("*").alias("n"))  # six rules


@query(
    "F8_F10_strand_slices",
    sql(
        """SELECT sid, reverse(translate(upper(seq), 'ACGT', 'TGCA')) AS rc, substr(seq, 11, 20) AS plus,
        reverse(translate(upper(substr(seq, length(seq) - 30 + 1, 20)), 'ACGT', 'TGCA')) AS minus FROM seqs WHERE length(seq) >= 40""",
        "seqs",
    ),
)
def strand_slices(spark, d):
    s = A.sequences(spark, d).where("length(seq) >= 40")
    cut = lambda sign: X.strand_slice("seq", F.lit(sign), F.lit(10), F.lit(30))
    return s.select("sid", X.reverse_complement("seq").alias("rc"), cut("+").alias("plus"), cut("-").alias("minus"))


@query(
    "F4_F6_overlap_measures",
    sql(
        CALLS
        + """, p AS (SELECT a.cid AS a, b.cid AS b, a.pos AS s1, a.pos + a.svlen AS e1, b.pos AS s2, b.pos + b.svlen AS e2, a.svlen AS l1, b.svlen AS l2,
                   least(a.pos + a.svlen, b.pos + b.svlen) - greatest(a.pos, b.pos) AS o
                   FROM calls a JOIN truth b ON a.chrom = b.chrom AND abs(a.pos - b.pos) <= 200)
        SELECT a, b, round(o::DOUBLE / least(l1, l2), 6) AS by_least, round(o::DOUBLE / greatest(l1, l2), 6) AS by_greatest,
               round(CASE WHEN o <= 0 THEN 1.0 ELSE 1 - least(o::DOUBLE / l1, o::DOUBLE / l2) END, 6) AS distance,
               abs(s1 - s2) < 20 AND abs(e1 - e2) < 20 AS similar FROM p""",
        "sigs",
    ),
)
def overlap_measures(spark, d):
    from ..operators.matching import within

    b = calls(spark, d, "A").select("chrom", F.col("cid").alias("b"), F.col("pos").alias("s2"), (F.col("pos") + F.col("svlen")).alias("e2"))
    a = calls(spark, d).select("chrom", F.col("cid").alias("a"), F.col("pos").alias("s1"), (F.col("pos") + F.col("svlen")).alias("e1"))
    p = within(a, b, ["chrom"], "s1", "s2", 200)
    ends = ("s1", "e1", "s2", "e2")
    return p.select(
        "a", "b", F.round(X.overlap_over_least(*ends), 6).alias("by_least"), F.round(X.overlap_over_greatest(*ends), 6).alias("by_greatest"),
        F.round(X.overlap_distance("s1", "e1", F.lit("L"), "s2", "e2", F.lit("R")), 6).alias("distance"),
        X.is_similar("chrom", "s1", "e1", "chrom", "s2", "e2").alias("similar"),
    )


@query(
    "F17_F18_info_fields",
    sql(
        """, v AS (SELECT concat('SVTYPE=', svtype, ';SVLEN=', svlen, ';RE=', mapq) AS info, concat(rname % 2, '|', rname % 3) AS gt FROM sigs)
        SELECT regexp_extract(info, 'SVTYPE=([^;]*)', 1) AS svtype, CAST(sum(CAST(regexp_extract(info, 'SVLEN=([^;]*)', 1) AS BIGINT)) AS BIGINT) AS length,
               array_to_string(list_sort(string_split(translate(gt, '|', '/'), '/')), '/') AS gt, count(*) AS n FROM v GROUP BY ALL""",
        "sigs",
    ),
)
def info_fields(spark, d):
    v = A.sigs(spark, d).select(
        F.concat(F.lit("SVTYPE="), "svtype", F.lit(";SVLEN="), F.col("svlen").cast("string"), F.lit(";RE="), F.col("mapq").cast("string")).alias("info"),
        F.concat((F.col("rname") % 2).cast("string"), F.lit("|"), (F.col("rname") % 3).cast("string")).alias("gt"),
    )
    return v.groupBy(X.info_value("info", "SVTYPE").alias("svtype"), X.normal_genotype("gt").alias("gt")).agg(
        F.sum(X.variant_length("info", F.lit("A"), F.lit("A"))).alias("length"), F.count("*").alias("n")
    )


@query(
    "F19_F20_breakends",
    sql(
        """, b AS (SELECT qname, ln, tie1, tie2, tie3, chrom, ref_start, CASE WHEN strand = '+' THEN '++' ELSE '-+' END AS o, lead(chrom) OVER w AS c2, lead(ref_start) OVER w AS p2
                   FROM segments WINDOW w AS (PARTITION BY qname ORDER BY ln, tie1, tie2, tie3))
        SELECT qname, CASE WHEN o = '++' THEN concat('N[', c2, ':', p2, '[') ELSE concat('[', c2, ':', p2, '[N') END AS alt, c2 AS mate_chrom, p2 AS mate_pos, o AS orientation,
               CASE WHEN (CAST(substr(chrom, 4) AS INT), ref_start) <= (CAST(substr(c2, 4) AS INT), p2) THEN concat(chrom, ':', ref_start) ELSE concat(c2, ':', p2) END AS first
        FROM b WHERE c2 <> chrom""",
        "segments",
    ),
)
def breakends(spark, d):
    from ..operators.segments import adjacent
    from .queries_segments import ORDER

    rows = adjacent(A.segments(spark, d), "qname", ORDER, ["chrom", "ref_start", "strand"]).where("chrom <> n_chrom")
    alt = X.breakend_alt(F.lit("N"), "n_chrom", "n_ref_start", F.when(F.col("strand") == "+", "++").otherwise("-+"))
    here = F.struct(X.chrom_number("chrom").alias("c"), F.col("ref_start").alias("p"), F.concat("chrom", F.lit(":"), F.col("ref_start").cast("string")).alias("t"))
    there = F.struct(X.chrom_number("n_chrom").alias("c"), F.col("n_ref_start").alias("p"), F.concat("n_chrom", F.lit(":"), F.col("n_ref_start").cast("string")).alias("t"))
    rows = rows.withColumn("alt", alt).withColumn("first", F.least(here, there)["t"])
    return rows.select("qname", "alt", X.parse_breakend("alt").alias("m"), "first").select("qname", "alt", "m.*", "first")


@query(
    "O2_ranked_by_chromosome",
    sql("SELECT chrom, svtype, pos, row_number() OVER (PARTITION BY svtype ORDER BY CAST(substr(chrom, 4) AS INT), pos) AS no FROM (SELECT DISTINCT chrom, svtype, pos FROM sigs WHERE svlen > 1500)", "sigs"),
)
def ranked_by_chromosome(spark, d):
    from pyspark.sql import Window

    rows = A.sigs(spark, d).where("svlen > 1500").select("chrom", "svtype", "pos").distinct().withColumn("k", X.chrom_number("chrom"))
    # numbers run over chromosomes: counts of the chromosomes before, then ranks in the own one
    counts = rows.groupBy("svtype", "k").agg(F.count("*").alias("c"))
    before = Window.partitionBy("svtype").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("svtype", "k", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy("svtype", "k").orderBy("pos")
    return rows.withColumn("i", F.row_number().over(inside)).join(offsets, ["svtype", "k"]).select("chrom", "svtype", "pos", (F.col("i") + F.col("off")).alias("no"))


@query("U2_union_of_ids", sql("SELECT rname FROM sigs WHERE svtype = 'DEL' UNION SELECT rname FROM sigs WHERE mapq > 50", "sigs"))
def union_of_ids(spark, d):
    s = A.sigs(spark, d)
    return s.where("svtype = 'DEL'").select("rname").union(s.where("mapq > 50").select("rname")).distinct()


@query("U3_common_ids", sql("SELECT rname FROM sigs WHERE svtype = 'DEL' AND mapq > 50 INTERSECT SELECT rname FROM sigs WHERE svtype = 'INS' AND mapq > 50", "sigs"))
def common_ids(spark, d):
    s = A.sigs(spark, d).where("mapq > 50")
    return s.where("svtype = 'DEL'").select("rname").intersect(s.where("svtype = 'INS'").select("rname"))


@query("U4_ids_left", sql("SELECT rname, chrom FROM sigs WHERE svtype = 'DEL' EXCEPT SELECT rname, chrom FROM sigs WHERE svtype = 'INS'", "sigs"))
def ids_left(spark, d):
    s = A.sigs(spark, d)
    return s.where("svtype = 'DEL'").select("rname", "chrom").subtract(s.where("svtype = 'INS'").select("rname", "chrom"))


@query("S1_region_scan", sql("SELECT chrom, pos, svlen, rname FROM sigs WHERE chrom = 'chr7' AND pos < 400000 AND pos + svlen > 100000", "sigs"))
def region_scan(spark, d):
    return A.sigs(spark, d).where("chrom = 'chr7' and pos < 400000 and pos + svlen > 100000").select("chrom", "pos", "svlen", "rname")


_folder = shared_folder


@query(
    "S5_S10_vcf_round_trip",
    sql(CALLS + "SELECT chrom, pos, svtype, CASE WHEN svtype = 'DEL' THEN -svlen ELSE svlen END AS svlen, '0/1' AS gt FROM calls", "sigs"),
)
def vcf_round_trip(spark, d):
    path = _folder(spark, "vcf")
    signed = F.when(F.col("svtype") == "DEL", -F.col("svlen")).otherwise(F.col("svlen"))
    T.write_vcf(calls(spark, d).withColumn("svlen", signed).withColumn("gt", F.lit("0/1")), path)
    v = T.read_vcf(spark, path)
    return v.select("chrom", "pos", X.info_value("info", "SVTYPE").alias("svtype"), X.variant_length("info", "ref", "alt").alias("svlen"), F.col("fmt")["GT"].alias("gt"))


@query("S6_S11_bed_round_trip", sql("""SELECT chrom, "start", "end" FROM regions""", "regions"))
def bed_round_trip(spark, d):
    path = _folder(spark, "bed")
    T.write_bed(A.regions(spark, d).select("chrom", "start", "end"), path)
    return T.read_bed(spark, path)


@query(
    "S3_S4_fasta_slices",
    sql(
        """SELECT concat('s', sid) AS name, length(seq) AS length, substr(seq, 5, 30) AS part, substr(seq, 991, 40) AS across,
               substr(seq, CAST(length(seq) // 2 + 1 AS BIGINT), 2500) AS half FROM seqs WHERE length(seq) > 0""",
        "seqs",
    ),
)
def fasta_slices(spark, d):
    """Slices at one place, over the border of two blocks, and over several blocks from the middle on."""
    path = _folder(spark, "fasta")
    T.write_fasta(A.sequences(spark, d).where("length(seq) > 0").select(F.concat(F.lit("s"), F.col("sid").cast("string")).alias("name"), "seq"), path)
    blocks = settled(R.read_reference(spark, path, 1000))
    rows = R.lengths(blocks, 1000)
    name, half = F.col("name"), F.floor(F.col("length") / 2)
    wanted = {"part": (name, F.lit(4), F.lit(34)), "across": (name, F.lit(990), F.lit(1030)), "half": (name, half, half + 2500)}
    return R.with_slices(rows, blocks, wanted, 1000)
