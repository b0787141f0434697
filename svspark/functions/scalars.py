"""Scalar functions on variants, alignments and calls, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def size_similarity(a, b) -> Column:
    """Lesser over greater length; null if both are 0."""
    a, b = F.abs(_c(a)), F.abs(_c(b))
    return F.try_divide(F.least(a, b), F.greatest(a, b))


def edit_similarity(a, b) -> Column:
    """(|a| + |b| - edits) / (|a| + |b|), upper-cased."""
    a, b = F.upper(_c(a)), F.upper(_c(b))
    total = F.length(a) + F.length(b)
    return F.try_divide(total - F.levenshtein(a, b), total)


def overlap_over_least(s1, e1, s2, e2) -> Column:
    """Common length over the lesser length; below 0 for intervals apart."""
    common = F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2))
    return F.try_divide(common, F.least(_c(e1) - _c(s1), _c(e2) - _c(s2)))


def overlap_over_greatest(s1, e1, s2, e2) -> Column:
    """Common length over the greater length (reciprocal overlap)."""
    common = F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2))
    return F.try_divide(common, F.greatest(_c(e1) - _c(s1), _c(e2) - _c(s2)))


def overlap_distance(s1, e1, d1, s2, e2, d2) -> Column:
    """1 - the lesser of the two overlap fractions; 1 if directions are equal or intervals apart."""
    common = F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2))
    least = F.least(F.try_divide(common, _c(e1) - _c(s1)), F.try_divide(common, _c(e2) - _c(s2)))
    return F.when((_c(d1) == _c(d2)) | (common <= 0), 1.0).otherwise(1 - least)


def is_similar(c1, s1, e1, c2, s2, e2, within: int = 20) -> Column:
    """Same chromosome and both ends less than ``within`` apart."""
    return (_c(c1) == _c(c2)) & (F.abs(_c(s1) - _c(s2)) < within) & (F.abs(_c(e1) - _c(e2)) < within)


def reverse_complement(s) -> Column:
    return F.reverse(F.translate(F.upper(_c(s)), "ACGT", "TGCA"))


def strand_slice(seq, strand, start, end) -> Column:
    """Bases [start, end) of a read as aligned: on the minus strand counted from its end and complemented."""
    seq, start, end = _c(seq), _c(start), _c(end)
    plus = F.substring(seq, (start + 1).cast("int"), (end - start).cast("int"))
    minus = reverse_complement(F.substring(seq, (F.length(seq) - end + 1).cast("int"), (end - start).cast("int")))
    return F.when(_c(strand) == "-", minus).otherwise(plus)


def read_to_strand(strand, length, q_start, q_end) -> tuple[Column, Column]:
    """Query coordinates counted along the read whichever strand it aligned to."""
    minus = _c(strand) == "-"
    return (
        F.when(minus, _c(length) - _c(q_end)).otherwise(_c(q_start)),
        F.when(minus, _c(length) - _c(q_start)).otherwise(_c(q_end)),
    )


def flag_class(flag) -> Column:
    """1 forward, 2 reverse, 3 and 4 the same for supplementary alignments, 0 anything else."""
    f = _c(flag)
    return F.when(f == 0, 1).when(f == 16, 2).when(f == 2048, 3).when(f == 2064, 4).otherwise(0)


def is_autosome(chrom) -> Column:
    return _c(chrom).rlike("^chr([1-9]|1[0-9]|2[0-2])$")


def chrom_number(chrom) -> Column:
    """The number of an autosome, else null; sorts chr2 before chr10."""
    return F.regexp_extract(_c(chrom), r"^chr(\d+)$", 1).try_cast("int")


def passes(filter, dots: bool = False) -> Column:
    """Whether a record's FILTER is PASS, or with ``dots`` a point."""
    return (_c(filter) == "PASS") | (F.lit(dots) & (_c(filter) == "."))


def reversed_interval(start, end, length) -> tuple[Column, Column]:
    """The interval [start, end) of a sequence seen from its other end."""
    return _c(length) - _c(end), _c(length) - _c(start)


def sequence_similarity(info) -> Column:
    """The value of PctSeqSimilarity in an INFO text, or null."""
    return F.nullif(F.regexp_extract(_c(info), r"(?:^|;)PctSeqSimilarity=([0-9.]+)", 1), F.lit("")).cast("double")


def reference_cap(n) -> Column:
    """Fixed values. How many spanning reads are looked at for a variant with ``n`` supporting reads."""
    n = _c(n)
    return F.when(n <= 2, 10 * n).when(n <= 5, 5 * n).when(n <= 15, 4 * n).otherwise(3 * n)


def normal_genotype(gt) -> Column:
    """Unphased with sorted alleles: 1|0 becomes 0/1."""
    return F.array_join(F.array_sort(F.split(F.translate(_c(gt), "|", "/"), "/")), "/")


def info_value(info, key: str) -> Column:
    """The value of ``key`` in a semicolon-separated INFO text, or null."""
    found = F.regexp_extract(_c(info), rf"(?:^|;){key}=([^;]*)", 1)
    return F.when(found != "", found)


def variant_length(info, ref, alt) -> Column:
    """SVLEN of INFO, else the difference of allele lengths."""
    return F.coalesce(info_value(info, "SVLEN").try_cast("long"), (F.length(_c(alt)) - F.length(_c(ref))).cast("long"))


def length_type(ref, alt, least: int = 50) -> Column:
    """DEL, INS or null by the difference of allele lengths."""
    diff = F.length(_c(alt)) - F.length(_c(ref))
    return F.when(diff >= least, "INS").when(diff <= -least, "DEL")


def breakend_alt(base, mate_chrom, mate_pos, orientation) -> Column:
    """ALT of a breakend; orientation is one of ++ +- -+ --: this side's and the mate's direction."""
    place = F.concat(_c(mate_chrom), F.lit(":"), _c(mate_pos).cast("string"))
    o, n = _c(orientation), _c(base)
    return (
        F.when(o == "++", F.concat(n, F.lit("["), place, F.lit("[")))
        .when(o == "+-", F.concat(n, F.lit("]"), place, F.lit("]")))
        .when(o == "-+", F.concat(F.lit("["), place, F.lit("["), n))
        .when(o == "--", F.concat(F.lit("]"), place, F.lit("]"), n))
    )


def parse_breakend(alt) -> Column:
    """struct(mate_chrom, mate_pos, orientation) of a breakend ALT; null fields for other alleles."""
    alt = _c(alt)
    bracket = F.regexp_extract(alt, r"[\[\]]", 0)
    first = alt.rlike(r"^[\[\]]")
    orientation = (
        F.when(first & (bracket == "["), "-+").when(first & (bracket == "]"), "--")
        .when(bracket == "[", "++").when(bracket == "]", "+-")
    )
    chrom = F.regexp_extract(alt, r"[\[\]]([^:\[\]]+):(\d+)[\[\]]", 1)
    return F.struct(
        F.when(chrom != "", chrom).alias("mate_chrom"),
        F.regexp_extract(alt, r"[\[\]]([^:\[\]]+):(\d+)[\[\]]", 2).try_cast("long").alias("mate_pos"),
        orientation.alias("orientation"),
    )


def region_name(chrom, start, end) -> Column:
    return F.format_string("Region_%s_S%d_E%d", _c(chrom), _c(start), _c(end))


def parse_region(name) -> Column:
    """struct(chrom, start, end) of a region name; negative starts become 0."""
    p = r"^Region_(\w+)_S(-?\d+)_E(-?\d+)$"
    return F.struct(
        F.regexp_extract(_c(name), p, 1).alias("chrom"),
        F.greatest(F.regexp_extract(_c(name), p, 2).try_cast("long"), F.lit(0)).alias("start"),
        F.regexp_extract(_c(name), p, 3).try_cast("long").alias("end"),
    )


def contig_name(header, length, haplotype: str | None = None) -> Column:
    """Name of an assembled contig from a header that holds its region: [haplotype_]chrom_start_end_block.

    The region is cut to [0, ``length``]; the block is what follows the header's last slash up to a
    point, without _hp1 and _hp2. Null for headers without a region.
    """
    region = r"Region_(chr\w+)_S(-?\d+)_E(-?\d+)"
    part = lambda k: F.regexp_extract(_c(header), region, k)
    start = F.greatest(part(2).try_cast("long"), F.lit(0))
    end = F.least(part(3).try_cast("long"), _c(length))
    block = F.regexp_replace(F.regexp_extract(_c(header), r"([^/]*)$", 1), r"\..*$|_hp[12]", "")
    name = F.concat_ws("_", *([F.lit(haplotype)] if haplotype else []), part(1), start.cast("string"), end.cast("string"), block)
    return F.when(_c(header).rlike(region), name)


def genotype(ref_reads, alt_reads, error: float = 0.1, prior: float = 1 / 3, most: int = 100) -> Column:
    """struct(gt, pl array, gq, qual) from counts of reads for and against a variant.

    Counts over ``most`` in sum are scaled down to it, the reference count cut to a whole number.
    Likelihoods are normalised in log space; the first of equal genotypes wins.
    """
    r, a = _c(ref_reads).cast("double"), _c(alt_reads).cast("double")
    total = r + a
    r0 = F.when(total > most, F.floor(most * r / total)).otherwise(r)
    counts = F.struct(r0.alias("r"), F.when(total > most, most - r0).otherwise(a).alias("a"))
    rest = F.log10(F.lit((1 - prior) / 2))
    yes, no, half = F.log10(F.lit(1 - error)), F.log10(F.lit(error)), F.log10(F.lit(0.5))

    def logs(c: Column) -> Column:
        return F.array(yes * c["r"] + no * c["a"] + rest, half * (c["r"] + c["a"]) + F.log10(F.lit(prior)), no * c["r"] + yes * c["a"] + rest)

    def normal(x: Column) -> Column:
        top = F.array_max(x)
        sum_ = F.aggregate(x, F.lit(0.0), lambda acc, y: acc + F.pow(F.lit(10.0), y - top))
        return F.transform(x, lambda y: y - top - F.log10(sum_))

    def call(n: Column) -> Column:
        # 1 - 10 ** x is floored where a genotype is all but certain
        doubt = F.transform(n, lambda y: F.floor(-10 * F.log10(F.greatest(1 - F.pow(F.lit(10.0), y), F.lit(1e-10)))).cast("int"))
        return F.struct(
            F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), F.array_position(n, F.array_max(n)).cast("int")).alias("gt"),
            F.transform(n, lambda y: F.rint(-10 * y).cast("int")).alias("pl"), F.array_max(doubt).alias("gq"), F.abs(F.rint(-100 * n[0]) / 10).alias("qual"),
        )

    # each step is bound once by a one-element transform, so that the expression doesn't multiply
    bound = F.array(counts)
    for step in (logs, normal, call):
        bound = F.transform(bound, step)
    return bound[0]


def corrected_genotype(svlen, gt, ratio, large_hom, small_hom, large_het, small_het, large: int = 1000) -> Column:
    """A call's genotype after a look at its share of supporting reads; null thresholds change nothing.

    Called homozygous, a variant is held to one pair of thresholds, called heterozygous to another,
    large variants to the first of each pair: over it the genotype is 1/1, else 0/1.
    """
    is_large = F.abs(_c(svlen)) > large
    limit = F.when(_c(gt) == "1/1", F.when(is_large, _c(large_hom)).otherwise(_c(small_hom))).otherwise(
        F.when(is_large, _c(large_het)).otherwise(_c(small_het))
    )
    return F.when(limit.isNull() | _c(ratio).isNull(), _c(gt)).when(_c(ratio) > limit, "1/1").otherwise("0/1")
