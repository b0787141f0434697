"""Readers and writers of the text formats: SAM, VCF, BED, FASTA, FASTQ, GFA and signature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import contig_name
from ..operators.segments import parse_cigar, reference_length

#: Header lines that the format prescribes.
VCF_HEADER = [
    "##fileformat=VCFv4.2",
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of the variant">',
    '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Difference of allele lengths">',
    '##INFO=<ID=END,Number=1,Type=Integer,Description="End of the variant">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
]


def _first_of_each(entries: Column) -> Column:
    """A map from an array of (k, v); of entries with one key the first counts."""
    keys = F.transform(entries, lambda e: e["k"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records of VCF files (plain or gzip): chrom, pos, id, ref, alt, qual, filter, info, fmt (map of the first sample).

    A quality of "." is null; of a repeated FORMAT key the first value counts. Header lines are left out; an empty file gives no rows.
    """
    fields = F.split(F.col("value"), "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(fields.alias("f"))
    at = lambda i: F.try_element_at(F.col("f"), F.lit(i))
    keys, values = F.split(at(9), ":"), F.split(at(10), ":")
    return rows.select(
        at(1).alias("chrom"), at(2).cast("long").alias("pos"), at(3).alias("id"), at(4).alias("ref"), at(5).alias("alt"),
        at(6).try_cast("double").alias("qual"), at(7).alias("filter"), at(8).alias("info"),
        _first_of_each(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"].isNotNull())).alias("fmt"),
    )


def write_vcf(calls: DataFrame, path: str, header: list[str] | None = None) -> None:
    """Writes calls (chrom, pos, svtype, svlen, gt[, id, ref, alt]) as sorted VCF parts.

    Parts are ranges of (chromosome number, position) in file order and the first begins with the
    header, so that reading the folder, or joining its parts by name, gives one file.
    """
    has = set(calls.columns)
    end = F.col("pos") + F.when(F.col("svtype") == "DEL", F.abs("svlen")).otherwise(0)
    info = F.concat(F.lit("SVTYPE="), "svtype", F.lit(";SVLEN="), F.col("svlen").cast("string"), F.lit(";END="), end.cast("string"))
    number = F.coalesce(F.regexp_extract("chrom", r"(\d+)$", 1).try_cast("int"), F.lit(1_000_000))
    line = F.concat_ws(
        "\t", "chrom", F.col("pos").cast("string"), "id" if "id" in has else F.lit("."), "ref" if "ref" in has else F.lit("N"),
        "alt" if "alt" in has else F.concat(F.lit("<"), "svtype", F.lit(">")), F.lit("."), F.lit("PASS"), info, F.lit("GT"), "gt",
    )
    names = "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "SAMPLE"])
    head = calls.sparkSession.createDataFrame([(-1, "", 0, "\n".join([*(header or VCF_HEADER), names]))], "_n int, chrom string, pos long, value string")
    rows = head.unionByName(calls.select(number.alias("_n"), "chrom", "pos", line.alias("value"))).repartitionByRange("_n", "chrom", "pos")
    rows.sortWithinPartitions("_n", "chrom", "pos").select("value").write.text(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end of BED files with three or more columns."""
    return spark.read.schema("chrom string, start long, end long").option("sep", "\t").option("comment", "#").csv(path)


def read_typed_bed(spark: SparkSession, path: str) -> DataFrame:
    """Target regions whose last column is a type: DUP with one place, INV and TRA with two.

    Returns svtype, chrom, start, end, chrom2, start2, end2.
    """
    f = spark.read.text(path).where(F.length("value") > 0).select(F.split("value", "\t").alias("f")).withColumn("n", F.size("f"))
    at = lambda i: F.try_element_at(F.col("f"), F.lit(i))
    two = F.col("n") >= 6
    second = F.when(F.col("n") == 7, at(4)).when(F.col("n") == 6, at(1))
    return f.select(
        F.element_at("f", -1).alias("svtype"), at(1).alias("chrom"), at(2).cast("long").alias("start"), at(3).cast("long").alias("end"),
        second.alias("chrom2"),
        F.when(two, F.when(F.col("n") == 7, at(5)).otherwise(at(4))).cast("long").alias("start2"),
        F.when(two, F.when(F.col("n") == 7, at(6)).otherwise(at(5))).cast("long").alias("end2"),
    )


def write_bed(rows: DataFrame, path: str) -> None:
    """Writes chrom, start, end and what follows as tab-separated parts, sorted."""
    rows.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "end").write.option("sep", "\t").csv(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of FASTA files: the name ends at the first blank, sequence lines are joined, upper case."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select(head.alias("name"), F.upper(body).alias("seq"))


def read_folded_contigs(spark: SparkSession, path: str, lengths: DataFrame, haplotype: str | None = None) -> DataFrame:
    """(name, seq) of assembled contigs in FASTA files whose headers may be folded over several lines.

    Lines of a record that hold other letters than A, C, G, T and N belong to its header. Names come
    from :func:`contig_name` with ``lengths`` (chrom, length), a sequence that isn't in it isn't cut, and end in the
    running number of their like, in order of the files. A header without a region gives a null name.
    """
    place = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i")]
    rows = spark.read.option("lineSep", ">").text(path).select("value", *place).where(F.length(F.trim("value")) > 0)
    lines = F.split("value", "\r?\n")
    base = lambda x: x.rlike("^[ACGTNacgtn]+$")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    head = F.concat(lines[0], F.array_join(F.filter(rest, lambda x: ~base(x)), ""))
    rows = rows.select(head.alias("head"), F.array_join(F.filter(rest, base), "").alias("seq"), "_f", "_b", "_i")
    rows = rows.withColumn("chrom", F.regexp_extract("head", r"Region_(chr\w+)_S-?\d+_E", 1)).join(lengths, "chrom", "left")
    rows = rows.withColumn("name", contig_name("head", "length", haplotype))
    number = F.row_number().over(Window.partitionBy("name").orderBy("_f", "_b", "_i"))
    return rows.select(F.concat("name", F.lit("-"), number.cast("string")).alias("name"), "seq")


def write_fasta(rows: DataFrame, path: str, width: int = 60) -> None:
    """Writes (name, seq) as FASTA with lines of ``width`` bases."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    rows.select(F.concat(F.lit(">"), "name", F.lit("\n"), lines).alias("value")).write.text(path)


def write_phase_blocks(reads: DataFrame, path: str) -> None:
    """Writes (ps, hp, name, seq) as FASTA folders by phase block and haplotype; a name is written once in each."""
    once = reads.dropDuplicates(["ps", "hp", "name"]).repartition("ps", "hp")
    once.select("ps", "hp", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.partitionBy("ps", "hp").text(path)


def read_phase_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(ps, hp, name, seq) of FASTA folders by phase block and haplotype."""
    rows = spark.read.option("lineSep", ">").schema("value string, ps long, hp long").text(path).where(F.length(F.trim("value")) > 0)
    return rows.select(
        "ps", "hp", F.regexp_extract("value", r"^(\S+)", 1).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq")
    )


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """A FASTA index: name, length, offset, bases and bytes a line."""
    return spark.read.schema("name string, length long, offset long, line_bases int, line_bytes int").option("sep", "\t").csv(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(qname, seq, qual) of FASTQ files with four lines a record.

    Lines are numbered in their file, by their place in a split and by the lines of the splits before
    (one row a split), and four in a row are a record; so a quality line may start with @. Empty lines
    at the end are left out. A file whose lines don't make whole records is refused with an error.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    ends = lines.groupBy("file", "block").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("file", "block", "low", before.alias("before"))
    rows = lines.join(ends, ["file", "block"]).withColumn("at", F.col("before") + F.col("id") - F.col("low"))
    part = lambda k: F.max(F.when(F.col("at") % 4 == k, F.col("value"))).alias(f"l{k}")
    records = rows.groupBy("file", F.floor(F.col("at") / 4).alias("record")).agg(F.count("*").alias("n"), *[part(k) for k in range(4)])
    empty = F.coalesce(F.length("l0"), F.lit(0)) + F.coalesce(F.length("l1"), F.lit(0)) == 0
    whole = (F.col("n") == 4) & F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    name = F.when(whole, F.regexp_extract("l0", r"^@(\S+)", 1)).otherwise(F.raise_error(F.lit("a FASTQ record without its four lines")))
    return records.where(~empty).select(name.alias("qname"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def read_gfa_segments(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of the S lines of assembly graphs."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.col("value").startswith("S\t")).select(f[1].alias("name"), f[2].alias("seq"))


def read_sigs(spark: SparkSession, path: str) -> DataFrame:
    """Signature tables: svtype, chrom, pos, svlen, rname and an optional sequence."""
    return spark.read.schema("svtype string, chrom string, pos long, svlen long, rname string, ins_seq string").option("sep", "\t").csv(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM files: qname, flag, chrom, ref_start, ref_end (0-based, half-open), mapq, cigar, seq, tags.

    Header lines and lines with fewer than eleven fields are left out; tags are a map from name to
    value, the first where one is repeated; unmapped records have no chromosome and no end.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(f.alias("f")).where(F.size("f") >= 11)
    at = lambda i: F.element_at(F.col("f"), i)
    tags = F.transform(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.split(t, ":", 3))
    rows = rows.select(
        at(1).alias("qname"), at(2).cast("int").alias("flag"), F.when(at(3) != "*", at(3)).alias("chrom"), (at(4).cast("long") - 1).alias("ref_start"),
        at(5).cast("int").alias("mapq"), at(6).alias("text"), at(10).alias("seq"),
        _first_of_each(F.transform(F.filter(tags, lambda t: F.size(t) == 3), lambda t: F.struct(t[0].alias("k"), t[2].alias("v")))).alias("tags"),
    )
    rows = rows.withColumn("cigar", parse_cigar("text")).drop("text")
    return rows.withColumn("ref_end", F.when(F.size("cigar") > 0, F.col("ref_start") + reference_length("cigar")))


def supplementary(reads: DataFrame) -> DataFrame:
    """The entries of SA tags: qname, chrom, ref_start (0-based), strand, cigar, mapq, nm.

    Entries with fewer than six fields are left out, further fields are ignored, a negative mapq is 0.
    """
    entry = F.explode(F.filter(F.split(F.col("tags")["SA"], ";"), lambda e: e != ""))
    f = F.split("e", ",")
    rows = reads.where(F.col("tags")["SA"].isNotNull()).select("qname", entry.alias("e")).select("qname", f.alias("f")).where(F.size("f") >= 6)
    rows = rows.select(
        "qname", F.col("f")[0].alias("chrom"), (F.col("f")[1].try_cast("long") - 1).alias("ref_start"), F.col("f")[2].alias("strand"),
        F.col("f")[3].alias("text"), F.greatest(F.col("f")[4].try_cast("int"), F.lit(0)).alias("mapq"), F.col("f")[5].try_cast("int").alias("nm"),
    )
    return rows.withColumn("cigar", parse_cigar("text")).drop("text")
