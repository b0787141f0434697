"""Queries that write files of the formats and read them back, and the small operators beside them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..lineage import settled
from ..operators import evaluation as E
from ..operators import intervals as I
from ..operators.clustering import signature_regions
from ..sources import indexed as X_
from ..sources import reference as R
from ..sources import tables as T
from . import adapters as A
from . import query
from .adapters import sql
from .queries_clusters import REGION_SQL
from .queries_matching import CALLS, calls
from .queries_scalars import _folder


def sam_lines(spark, d):
    """Segments as SAM records: forward or reverse, clipped on both sides, with one SA entry."""
    s = A.segments(spark, d)
    text = lambda c: F.col(c).cast("string")
    cigar = F.concat(text("ln"), F.lit("S"), (F.col("ref_end") - F.col("ref_start")).cast("string"), F.lit("M9S"))
    sa = F.concat(F.lit("SA:Z:chr9,"), text("tie1"), F.lit(",-,10S90M,"), (F.col("mapq") - 30).cast("string"), F.lit(",3;bad,1;"))
    flag = F.when(F.col("strand") == "-", "16").otherwise("0")
    return s.select(
        F.concat_ws("\t", F.concat(F.lit("q"), text("qname")), flag, "chrom", (F.col("ref_start") + 1).cast("string"), text("mapq"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), sa)
    )


@query(
    "S1_sam_round_trip",
    sql(
        """SELECT concat('q', qname) AS qname, CASE WHEN strand = '-' THEN 16 ELSE 0 END AS flag, ref_start, ref_end, tie1 - 1 AS sa_start, greatest(mapq - 30, 0) AS sa_mapq
        FROM segments WHERE chrom = 'chr2' AND ref_start < 60000 AND ref_end > 10000""",
        "segments",
    ),
)
def sam_round_trip(spark, d):
    """SAM files read once into an index by place; a region then opens the folders that it touches."""
    path, index = _folder(spark, "sam"), _folder(spark, "reads")
    sam_lines(spark, d).write.text(path)
    X_.write_reads(T.read_sam(spark, path), index)
    region = spark.createDataFrame([("chr2", 10000, 60000)], "chrom string, start long, end long")
    reads = X_.reads_in_regions(spark, index, region)
    entry = F.try_element_at(F.filter(F.split(F.col("tags")["SA"], ";"), lambda e: F.size(F.split(e, ",")) >= 6), F.lit(1))
    f = F.split(entry, ",")
    return reads.select("qname", "flag", "ref_start", "ref_end", (f[1].cast("long") - 1).alias("sa_start"), F.greatest(f[4].cast("int"), F.lit(0)).alias("sa_mapq"))


@query(
    "S2_region_files",
    sql(
        """, far AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM regions),
        parts AS (SELECT *, count(*) FILTER (WHERE reach IS NULL OR "start" > reach) OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS part FROM far),
        merged AS (SELECT chrom, min("start") AS low, max("end") AS high FROM parts GROUP BY chrom, part)
        SELECT concat('Region_', r.chrom, '_S', low, '_E', high) AS region, s.pos AS ref_start, s.pos + s.svlen AS ref_end, s.rname, s.ln, s.okey
        FROM merged r JOIN sigs s ON s.chrom = r.chrom AND s.pos < high AND s.pos + s.svlen > low WHERE s.svtype = 'DEL'""",
        "regions",
        "sigs",
    ),
)
def region_files(spark, d):
    """One folder a merged region, cropped from reads that are indexed by place, and all folders read again."""
    s = A.sigs(spark, d).where("svtype = 'DEL'").select("chrom", F.col("pos").alias("ref_start"), (F.col("pos") + F.col("svlen")).alias("ref_end"), "rname", "ln", "okey")
    index, path = _folder(spark, "reads"), _folder(spark, "cropped")
    X_.write_reads(s, index)
    X_.crop_regions(spark, index, I.merge_intervals(A.regions(spark, d), ["chrom"], "start", "end", 1), path)
    return spark.read.parquet(path).select("region", "ref_start", "ref_end", "rname", "ln", "okey")


@query("S7_signature_files", sql("SELECT chrom, pos, svlen, count(*) AS reads FROM sigs WHERE svtype = 'INS' AND svlen >= 30 GROUP BY ALL", "sigs"))
def signature_files(spark, d):
    path = _folder(spark, "sigs")
    A.sigs(spark, d).select("svtype", "chrom", "pos", "svlen", "rname").write.option("sep", "\t").csv(path)
    return T.read_sigs(spark, path).where("svtype = 'INS' and svlen >= 30").groupBy("chrom", "pos", "svlen").agg(F.count("*").alias("reads"))


@query("S9_bed_by_chromosome", sql("""SELECT chrom, count(*) AS n, min("start") AS first, max("end") AS last FROM regions GROUP BY chrom""", "regions"))
def bed_by_chromosome(spark, d):
    path = _folder(spark, "beds")
    A.regions(spark, d).select("chrom", F.col("chrom").alias("name"), "start", "end").repartition("chrom").write.partitionBy("chrom").option("sep", "\t").csv(path)
    rows = spark.read.schema("name string, start long, end long, chrom string").option("sep", "\t").csv(path)
    return rows.groupBy("chrom").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))


@query(
    "S12_phase_block_files",
    sql("SELECT DISTINCT sid % 7 AS ps, CASE WHEN sid % 7 = 0 THEN 0 ELSE sid % 2 + 1 END AS hp, concat('r', sid) AS name, length(seq) AS length FROM seqs WHERE length(seq) > 0", "seqs"),
)
def phase_block_files(spark, d):
    path = _folder(spark, "phased")
    s = A.sequences(spark, d).where("length(seq) > 0")
    ps = F.col("sid") % 7
    reads = s.select(ps.alias("ps"), F.when(ps == 0, 0).otherwise(F.col("sid") % 2 + 1).alias("hp"), F.concat(F.lit("r"), F.col("sid").cast("string")).alias("name"), "seq")
    T.write_phase_blocks(reads.unionByName(reads.where("ps = 3")), path)  # repeated names are written once
    return T.read_phase_blocks(spark, path).select("ps", "hp", "name", F.length("seq").alias("length"))


@query(
    "S14_graph_segments",
    sql(
        """SELECT concat('u', sid) AS name, block, md5(substr(seq, block * 4096 + 1, 4096)) AS digest
        FROM (SELECT sid, seq, unnest(generate_series(0, (length(seq) - 1) // 4096)) AS block FROM seqs WHERE length(seq) > 0)""",
        "seqs",
    ),
)
def graph_segments(spark, d):
    """Segments of an assembly graph, written as FASTA and read in blocks."""
    path = _folder(spark, "gfa")
    name = F.concat(F.lit("u"), F.col("sid").cast("string"))
    s = A.sequences(spark, d).where("length(seq) > 0")
    lines = s.select(F.concat_ws("\t", F.lit("S"), name, "seq").alias("value")).unionByName(s.select(F.concat_ws("\t", F.lit("L"), name, F.lit("+"), name).alias("value")))
    lines.write.text(path)
    fasta = _folder(spark, "contigs")
    T.write_fasta(T.read_gfa_segments(spark, path), fasta)
    return R.read_reference(spark, fasta, 4096).select("name", "block", F.md5("bases").alias("digest"))


@query(
    "S15_merged_vcf",
    sql(CALLS + """SELECT chrom, count(*) AS n, min(pos) AS first, max(pos) AS last FROM calls GROUP BY chrom""", "sigs"),
)
def merged_vcf(spark, d):
    """One VCF a chromosome, read together, merged in order into one and read again."""
    part, whole = _folder(spark, "parts"), _folder(spark, "merged")
    rows = calls(spark, d).withColumn("gt", F.lit("0/1"))
    for k in range(2):  # two callers' files; their chromosomes are directories of one write
        T.write_vcf(rows.where(F.pmod(F.xxhash64("chrom"), F.lit(2)) == k), f"{part}/{k}")
    v = T.read_vcf(spark, f"{part}/*")
    T.write_vcf(v.select("chrom", "pos", X.info_value("info", "SVTYPE").alias("svtype"), X.variant_length("info", "ref", "alt").alias("svlen"), F.col("fmt")["GT"].alias("gt")), whole)
    return T.read_vcf(spark, whole).groupBy("chrom").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("S17_reads_by_name", sql("SELECT concat('r', sid) AS qname, length(seq) AS n, md5(seq) AS digest FROM seqs WHERE length(seq) > 0 AND sid % 3 = 1", "seqs"))
def reads_by_name(spark, d):
    """Every third read by its name: an index of byte ranges says what is read of the files."""
    path = _folder(spark, "fastq")
    s = A.sequences(spark, d).where("length(seq) > 0")
    lines = F.concat(F.lit("@r"), F.col("sid").cast("string"), F.lit(" lane\n"), "seq", F.lit("\n+\n"), F.expr("repeat('I', length(seq))"))
    s.select(lines.alias("value")).write.text(path)
    index = X_.save_index(X_.fastq_index(spark, path), _folder(spark, "fastq-index"))
    names = A.table(spark, d, "documents").where("doc_id % 3 = 1").select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("qname"))
    return X_.reads_by_name(index, names).where("length(qual) = length(seq)").select("qname", F.length("seq").alias("n"), F.md5("seq").alias("digest"))


@query("S17_fastq_round_trip", sql("SELECT concat('r', sid) AS qname, length(seq) AS n, md5(seq) AS digest FROM seqs WHERE length(seq) > 0", "seqs"))
def fastq_round_trip(spark, d):
    path = _folder(spark, "fastq")
    s = A.sequences(spark, d).where("length(seq) > 0")
    quality = F.concat(F.lit("@"), F.expr("repeat('I', length(seq) - 1)"))
    s.select(F.concat(F.lit("@r"), F.col("sid").cast("string"), F.lit(" lane\n"), "seq", F.lit("\n+\n"), quality).alias("value")).write.text(path)
    return T.read_fastq(spark, path).where("length(qual) = length(seq)").select("qname", F.length("seq").alias("n"), F.md5("seq").alias("digest"))


@query("S18_sample_sheet", sql("SELECT tool, svtype, count(*) AS n FROM sigs CROSS JOIN (VALUES ('a', 'DEL'), ('b', 'INS'), ('b', 'DEL')) t(tool, kind) WHERE svtype = kind GROUP BY ALL", "sigs"))
def sample_sheet(spark, d):
    """A sheet of rows (dtype, tool, folder) says which call files are read, each once."""
    sheet, root = _folder(spark, "sheet"), _folder(spark, "sets")
    A.sigs(spark, d).select("svtype", F.col("svtype").alias("kind"), "chrom", "pos").write.partitionBy("kind").parquet(root)
    spark.createDataFrame([("HIFI", "a", "DEL"), ("CLR", "b", "INS"), ("CLR", "b", "DEL")], "dtype string, tool string, kind string").write.csv(sheet)
    rows = spark.read.schema("dtype string, tool string, kind string").csv(sheet)
    return spark.read.parquet(root).join(F.broadcast(rows), "kind").groupBy("tool", "svtype").agg(F.count("*").alias("n"))


@query("S19_sequence_index", sql("SELECT concat('s', sid) AS name, CAST(length(seq) AS BIGINT) AS length, CAST(60 AS INT) AS line_bases FROM seqs WHERE length(seq) > 0", "seqs"))
def sequence_index(spark, d):
    path = _folder(spark, "fai")
    s = A.sequences(spark, d).where("length(seq) > 0")
    s.select(F.concat(F.lit("s"), F.col("sid").cast("string")), F.length("seq"), F.lit(0), F.lit(60), F.lit(61)).write.option("sep", "\t").csv(path)
    return T.read_fai(spark, path).select("name", "length", "line_bases")


# small operators

MARKED = """, marked AS (SELECT *, CASE WHEN svlen % 3 = 0 THEN 'PASS' WHEN svlen % 3 = 1 THEN '.' ELSE 'q5' END AS filter FROM sigs)"""


@query("P4_passing_calls", sql(MARKED + "SELECT filter, count(*) AS n FROM marked WHERE filter IN ('PASS', '.') GROUP BY filter", "sigs"))
def passing_calls(spark, d):
    marked = A.sigs(spark, d).withColumn("filter", F.when(F.col("svlen") % 3 == 0, "PASS").when(F.col("svlen") % 3 == 1, ".").otherwise("q5"))
    return marked.where(X.passes("filter", dots=True)).groupBy("filter").agg(F.count("*").alias("n"))


@query("P14_read_gates", sql("SELECT qname, ref_start FROM (SELECT *, max(q_end) OVER (PARTITION BY qname) AS read_len FROM segments) WHERE read_len >= 2500 AND mapq >= 40", "segments"))
def read_gates(spark, d):
    rows = A.segments(spark, d).withColumn("read_len", F.max("q_end").over(Window.partitionBy("qname")))
    return rows.where("read_len >= 2500 and mapq >= 40").select("qname", "ref_start")


DICTS = """, a AS (SELECT rname, min(pos) AS a_pos FROM sigs WHERE svtype = 'DEL' AND mapq > 50 GROUP BY rname), b AS (SELECT rname, max(pos) AS b_pos FROM sigs WHERE svtype = 'INS' AND mapq > 50 GROUP BY rname)"""


@query("U5_union_of_keys", sql(DICTS + "SELECT coalesce(a.rname, b.rname) AS rname, a_pos, b_pos FROM a FULL JOIN b ON a.rname = b.rname", "sigs"))
def union_of_keys(spark, d):
    s = A.sigs(spark, d).where("mapq > 50")
    a = s.where("svtype = 'DEL'").groupBy("rname").agg(F.min("pos").alias("a_pos"))
    return a.join(s.where("svtype = 'INS'").groupBy("rname").agg(F.max("pos").alias("b_pos")), "rname", "full")


@query(
    "J16_outer_merged_summaries",
    sql("""SELECT coalesce(a.chrom, b.chrom) AS chrom, a.n AS dels, b.n AS long_ins FROM (SELECT chrom, count(*) AS n FROM sigs WHERE svtype = 'DEL' AND svlen > 1500 GROUP BY chrom) a
        FULL JOIN (SELECT chrom, count(*) AS n FROM sigs WHERE svtype = 'INS' AND svlen > 1510 GROUP BY chrom) b ON a.chrom = b.chrom""", "sigs"),
)
def outer_merged_summaries(spark, d):
    s = A.sigs(spark, d)
    count = lambda rows, name: rows.groupBy("chrom").agg(F.count("*").alias(name))
    return count(s.where("svtype = 'DEL' and svlen > 1500"), "dels").join(count(s.where("svtype = 'INS' and svlen > 1510"), "long_ins"), "chrom", "full")


@query("W9_dense_ranks", sql("SELECT chrom, pos, dense_rank() OVER (PARTITION BY chrom ORDER BY pos // 100000) AS rank FROM (SELECT DISTINCT chrom, pos FROM sigs)", "sigs"))
def dense_ranks(spark, d):
    """Ranks of distinct bins are few; rows take theirs by a join."""
    rows = A.sigs(spark, d).select("chrom", "pos").distinct().withColumn("bin", F.expr("pos div 100000"))
    bins = rows.select("chrom", "bin").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("chrom").orderBy("bin")))
    return rows.join(bins, ["chrom", "bin"]).select("chrom", "pos", F.col("rank").cast("long"))


@query(
    "O7_A21_sampled_coverage",
    sql(
        """, b AS (SELECT chrom, unnest(generate_series(pos // 500000, (pos + svlen - 1) // 500000)) AS bin, pos, svlen FROM sigs),
        c AS (SELECT chrom, bin, CAST(sum(least(pos + svlen, (bin + 1) * 500000) - greatest(pos, bin * 500000)) AS BIGINT) AS bases FROM b GROUP BY chrom, bin),
        k AS (SELECT * FROM c ORDER BY md5(concat('0', chrom, ':', bin)) LIMIT 100)
        SELECT count(*) AS bins, CAST(sum(bases) AS BIGINT) AS bases, round(avg(bases / 500000.0), 6) AS coverage FROM k""",
        "sigs",
    ),
)
def sampled_coverage(spark, d):
    """Mean coverage of a hundred bins drawn without replacement by a hash of their names: the sample is the feature."""
    reads = A.sigs(spark, d).select("chrom", F.col("pos").alias("r_start"), (F.col("pos") + F.col("svlen")).alias("r_end"))
    some = E.sample_by_hash(I.coverage_bins(reads, ["chrom"], 500_000), F.concat("chrom", F.lit(":"), F.col("bin").cast("string")), 100)
    return some.agg(F.count("*").alias("bins"), F.sum("bases").cast("long").alias("bases"), F.round(F.avg(F.col("bases") / 500_000.0), 6).alias("coverage"))


@query(
    "O8_ranked_regions",
    sql(
        """, n AS (SELECT r.rid, count(p.pos) AS n FROM regions r LEFT JOIN sigs p ON p.chrom = r.chrom AND p.svtype = 'DEL' AND p.pos BETWEEN r."start" AND r."end" GROUP BY r.rid),
        c AS (SELECT n, count(*) AS k, sum(count(*)) OVER (ORDER BY n) AS upto FROM n GROUP BY n), t AS (SELECT count(*) AS every FROM n)
        SELECT rid, n.n, CASE WHEN upto <= 0.1 * every THEN 'bottom10' WHEN upto <= 0.5 * every THEN 'bottom50' WHEN upto - k >= 0.9 * every THEN 'top10' WHEN upto - k >= 0.5 * every THEN 'top50' ELSE 'middle' END AS class
        FROM n JOIN c ON n.n = c.n CROSS JOIN t""",
        "regions", "sigs",
    ),
)
def ranked_regions(spark, d):
    from ..operators.matching import regions_of_points

    points = A.sigs(spark, d).where("svtype = 'DEL'").select("chrom", "pos")
    return E.rank_classes(regions_of_points(A.regions(spark, d), points, ["chrom"]).select("rid", "n"), "n", [0.1, 0.5])


@query("F9_F25_reversed", sql("SELECT sid, md5(reverse(seq)) AS back, greatest(length(seq) - 40, 0) AS low, length(seq) - least(10, length(seq)) AS high FROM seqs", "seqs"))
def reversed_reads(spark, d):
    n = F.length("seq")
    low, high = X.reversed_interval(F.least(F.lit(10), n), F.least(F.lit(40), n), n)
    return A.sequences(spark, d).select("sid", F.md5(F.reverse("seq")).alias("back"), low.alias("low"), high.alias("high"))


@query(
    "F12_read_coordinates",
    sql("SELECT qname, ln, CASE WHEN strand = '-' THEN 9000 - q_end ELSE q_start END AS low, CASE WHEN strand = '-' THEN 9000 - q_start ELSE q_end END AS high FROM segments", "segments"),
)
def read_coordinates(spark, d):
    low, high = X.read_to_strand("strand", F.lit(9000).cast("long"), "q_start", "q_end")
    return A.segments(spark, d).select("qname", "ln", low.alias("low"), high.alias("high"))


@query(
    "F15_reference_caps",
    sql("SELECT n, CAST(CASE WHEN n <= 2 THEN 10 * n WHEN n <= 5 THEN 5 * n WHEN n <= 15 THEN 4 * n ELSE 3 * n END AS BIGINT) AS cap, count(*) AS calls FROM (SELECT count(*) AS n FROM sigs GROUP BY chrom, pos // 20000) GROUP BY n", "sigs"),
)
def reference_caps(spark, d):
    n = A.sigs(spark, d).groupBy("chrom", F.expr("pos div 20000")).agg(F.count("*").alias("n"))
    return n.groupBy("n").agg(F.count("*").alias("calls")).withColumn("cap", X.reference_cap("n").cast("long"))


@query(
    "F23_F26_match_records",
    sql(CALLS + """SELECT cid, svlen / 1000.0 AS similarity, '{"chrom":"' || chrom || '","pos":' || pos || ',"svlen":' || svlen || '}' AS record FROM calls""", "sigs"),
)
def match_records(spark, d):
    info = F.concat(F.lit("SVTYPE="), "svtype", F.lit(";PctSeqSimilarity="), (F.col("svlen") / 1000.0).cast("string"), F.lit(";X=1"))
    return calls(spark, d).select("cid", X.sequence_similarity(info).alias("similarity"), F.to_json(F.struct("chrom", "pos", "svlen")).alias("record"))


MERGED = """, {name}_r AS (
    SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {source}
), {name}_n AS (
    SELECT *, sum(CASE WHEN far IS NULL OR "start" - far >= 15000 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS cid FROM {name}_r
), {name} AS (SELECT chrom, greatest(min("start") - {flank}, 0) AS "start", max("end") + {flank} AS "end", count(*) AS n FROM {name}_n GROUP BY chrom, cid)"""


@query(
    "A5_three_merges",
    sql(
        REGION_SQL
        + """, dp AS (SELECT chrom, "start", "end" FROM found WHERE svtype = 'DEL' UNION ALL SELECT chrom, "start", "end" FROM regions),
        ip AS (SELECT chrom, "start", "end" FROM found WHERE svtype = 'INS' UNION ALL SELECT chrom, "start", "end" FROM regions)"""
        + MERGED.format(name="dm", source="dp", flank=7000) + MERGED.format(name="im", source="ip", flank=7000)
        + """, both_ AS (SELECT chrom, "start", "end" FROM dm UNION ALL SELECT chrom, "start", "end" FROM im)""" + MERGED.format(name="whole", source="both_", flank=0)
        + """SELECT chrom, "start", "end", n FROM whole""",
        "sigs", "regions",
    ),
)
def three_merges(spark, d):
    found = settled(signature_regions(A.sigs(spark, d)))
    prior = A.regions(spark, d).select("chrom", "start", "end")
    merged = [
        I.merge_intervals(found.where(F.col("svtype") == kind).select("chrom", "start", "end").unionByName(prior), ["chrom"], "start", "end", 15000, flank=7000)
        for kind in ("DEL", "INS")
    ]
    both = merged[0].unionByName(merged[1]).select("chrom", "start", "end")
    return I.merge_intervals(both, ["chrom"], "start", "end", 15000)


#: Assembled contigs: a sequence's region, which may reach beyond both ends of its chromosome, and its block.
CONTIGS = """
sid;
seq;
concat('chr', CAST(sid % 3 + 1 AS STRING)) AS chrom;
(sid % 50) * 1000 - 5000 AS start;
(sid % 50) * 1000 + 40000 AS end;
concat('blk', CAST(sid % 2 AS STRING), 'z') AS block
"""
CONTIG_ENDS = [("chr1", 60_000), ("chr2", 70_000)]


@query(
    "F24_folded_headers",
    sql(
        ", c AS (SELECT " + CONTIGS.strip().replace(";\n", ",\n").replace("AS STRING", "AS VARCHAR").replace("AS start", 'AS "start"').replace("AS end", 'AS "end"') + " FROM seqs),"
        + f""" n AS (SELECT sid, seq, concat('hp1_', chrom, '_', greatest("start", 0), '_', least("end", l.length), '_', block) AS name FROM c LEFT JOIN (VALUES {", ".join(map(repr, CONTIG_ENDS))}) AS l(chrom, length) USING (chrom))
        SELECT concat(name, '-', row_number() OVER (PARTITION BY name ORDER BY sid)) AS name, length(seq) AS n, md5(seq) AS digest FROM n""",
        "seqs",
    ),
)
def folded_headers(spark, d):
    """Contigs whose headers are folded at each slash, written in order, read back and named by their regions."""
    path = _folder(spark, "contigs")
    c = A.sequences(spark, d).selectExpr(*[x.strip() for x in CONTIGS.strip().split(";\n")])
    head = F.concat(F.lit(">asm/run_1/"), X.region_name("chrom", "start", "end"), F.lit("/out_hp1/"), "block", F.lit("_hp1.p.fa"))
    lines = F.concat_ws("\n", F.regexp_replace(head, "/", "/\n"), F.when(F.col("seq") != "", F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")))
    c.select("sid", lines.alias("value")).repartitionByRange("sid").sortWithinPartitions("sid").select("value").write.text(path)
    ends = spark.createDataFrame(CONTIG_ENDS, "chrom string, length long")
    return T.read_folded_contigs(spark, path, ends, "hp1").select("name", F.length("seq").alias("n"), F.md5("seq").alias("digest"))
