"""Blocked reference sequences, reads indexed by place and FASTQ records by name."""

import random

import pytest
from pyspark.sql import functions as F

from svspark.sources import indexed, reference, tables


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def genome(seed=3):
    r = random.Random(seed)
    return {name: "".join(r.choice("ACGTacgtN") for _ in range(n)) for name, n in (("chr1", 731), ("chr2", 64), ("chrE", 0), ("chrX", 5), ("chrM", 400))}


@pytest.mark.parametrize("block", [7, 64, 100, 1 << 16])
def test_reference_blocks_over_splits(spark, tmp_path, small_splits, block):
    want = genome()
    text = ["; a line before the first header"]
    for i, (name, seq) in enumerate(want.items()):
        text.append(f">{name} some words > here")
        width = (13, 80, 60, 60, 400)[i]
        text += [seq[k : k + width] + (" " if k % 2 else "") for k in range(0, len(seq), width)] + [""] * (i % 2)
    (tmp_path / "a.fa").write_text("\n".join(text) + "\n")
    (tmp_path / "b.fa").write_text(">chr9\r\nACGT\r\nAC\r\n")
    want["chr9"] = "ACGTAC"
    df = reference.read_reference(spark, str(tmp_path), block)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    rows = df.collect()
    assert len({(r["name"], r["block"]) for r in rows}) == len(rows) and all(0 < len(r["bases"]) <= block for r in rows)
    got = {}
    for r in sorted(rows, key=lambda r: (r["name"], r["block"])):
        assert r["block"] * block == len(got.setdefault(r["name"], ""))
        got[r["name"]] += r["bases"]
    assert got == {k: v.upper() for k, v in want.items() if v}
    assert {r["name"]: r["length"] for r in reference.lengths(df, block).collect()} == {k: len(v) for k, v in want.items() if v}


def test_slices_from_blocks(spark):
    want = {k: v.upper() for k, v in genome(5).items()}
    blocks = reference.blocks_of(spark.createDataFrame(list(want.items()), "name string, seq string"), block=50).cache()
    assert blocks.agg(F.max(F.length("bases"))).first()[0] == 50
    r = random.Random(1)
    rows = [(i, r.choice(["chr1", "chr1", "chrM", "chrX"]), r.randint(-20, 800), r.randint(-20, 800), "x") for i in range(300)]
    rows += [(300, "chr1", 50, 100, "x"), (301, "chr1", 49, 51, "x"), (302, "chr1", 100, 100, "x"), (303, "nowhere", 1, 5, "x"), (304, None, 1, 5, "x"), (305, "chr1", None, 5, "x"), (306, "chr1", 0, 731, "x"), (307, "chr2", 64, 90, "x"), (307, "chr2", 64, 90, "x")]
    df = spark.createDataFrame(rows, "id long, chrom string, start long, end long, bases string")
    wanted = {"one": (F.col("chrom"), F.col("start"), F.col("end")), "two": (F.col("chrom"), F.col("start") - 100, F.col("start"))}
    got = reference.with_slices(df, blocks, wanted, block=50)
    assert got.columns == [*df.columns, "one", "two"] and got.count() == len(rows)

    def cut(c, a, b):
        return None if c not in want or a is None or b is None else want[c][max(a, 0) : max(b, 0)] if b > a else ""

    for x in got.collect():
        assert x["one"] == cut(x["chrom"], x["start"], x["end"]), x
        assert x["two"] == cut(x["chrom"], x["start"] and x["start"] - 100, x["start"]), x


def files_read(df):
    """How many files the scan of a plan opened; it has to have run without adaptive execution."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))


def test_region_reads_open_the_folders_of_the_regions(spark, tmp_path):
    r = random.Random(7)
    widths = (1000, 8000, 64000, 512000)
    rows = [(i, r.choice(["1", "2", "X"]), s := r.randint(0, 40_000), s + r.choice([1, 50, 900, 1000, 7000, 90_000])) for i in range(1000)]
    rows += [(9000, "1", 900_000, 900_010), (9001, "2", 0, 600_000), (9002, "X", 5, 5), (9003, None, None, None), (9004, "7", 10, 20)]
    df = spark.createDataFrame(rows, "rid long, chrom string, ref_start long, ref_end long").repartition(3)
    path = str(tmp_path / "reads")
    indexed.write_reads(df, path, widths)
    every = spark.read.parquet(path)
    assert every.count() == len(rows)
    regions = [("1", 5000, 5600, 1), ("1", 5500, 7100, 2), ("2", 39_000, 39_001, 3), ("X", 4000, 4000, 4), ("9", 1, 5, 5), ("1", 0, 1, 6)]
    asked = spark.createDataFrame(regions, "chrom string, start long, end long, region int")
    found = indexed.reads_in_regions(spark, path, asked, widths)
    got = sorted((x["region"], x["rid"]) for x in found.collect())
    assert got == sorted((k, i) for c, s, e, k in regions for i, d, a, b in rows if c == d and s < e and a < b and a < e and b > s)
    whole = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = spark.read.parquet(path).select("rid")
        plain.collect()
        one = indexed.scan_bins(spark, path, [("1", "0_5"), ("1", "1_0")])
        assert {x["_bin"] for x in one.collect()} <= {"0_5", "1_0"}
        assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()
        assert 0 < files_read(one) <= 4 < files_read(plain) / 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", whole)
    out = str(tmp_path / "cropped")
    once = [x for x in regions if x[3] != 4]
    spark_regions = spark.createDataFrame(once + once[:1], "chrom string, start long, end long, region int")
    indexed.write_reads(df, str(tmp_path / "r2"))  # the default widths
    indexed.crop_regions(spark, str(tmp_path / "r2"), spark_regions, out, most=100)
    crop = {(x["region"], x["rid"]) for x in spark.read.parquet(out).collect()}
    names = {x[3]: f"Region_{x[0]}_S{x[1]}_E{x[2]}" for x in once}
    assert crop == {(names[k], i) for k, i in got if k in names}


def test_fastq_records_by_name_read_their_bytes_only(spark, tmp_path, small_splits):
    r = random.Random(2)
    want, total = {}, 0
    for file in range(3):
        text = ""
        for i in range(40):
            seq = "".join(r.choice("ACGT") for _ in range(r.randint(1, 120)))
            qual = "".join(r.choice("@+I#>") for _ in seq)
            name = f"r{file}_{i}" if i else "same"
            want.setdefault(name, []).append((seq, qual))
            text += f"@{name} lane {i}\n{seq}\n+{name if i % 2 else ''}\n{qual}\n"
        if file == 2:
            text = text[:-1] + "\n\n"  # an empty line at the end
        (tmp_path / f"{file}.fq").write_text(text)
        total += len(text)
    index = indexed.save_index(indexed.fastq_index(spark, f"{tmp_path}/*.fq"), str(tmp_path / "index"))
    assert index.count() == 120 and index.agg(F.sum("length")).first()[0] in (total, total - 1)
    asked = ["r0_3", "r1_39", "r2_1", "same", "missing", "r0_3"]
    got = indexed.reads_by_name(index, spark.createDataFrame([(n,) for n in asked], "qname string")).collect()
    assert sorted((x["qname"], x["seq"], x["qual"]) for x in got) == sorted((n, *p) for n in set(asked) for p in want.get(n, []))
    assert sum(x["bytes"] for x in got) < total / 10
    (tmp_path / "bad.fq").write_text("@a\nAC\n+\n")
    with pytest.raises(Exception, match="four lines"):
        indexed.fastq_index(spark, f"{tmp_path}/bad.fq").collect()


def test_repeated_tags_and_format_keys(spark, tmp_path):
    (tmp_path / "a.sam").write_text("q\t0\tchr1\t5\t60\t3M\t*\t0\t0\tACG\t*\tNM:i:1\tNM:i:2\tXX:Z:a:b\nz\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    rows = {r["qname"]: r for r in tables.read_sam(spark, str(tmp_path / "a.sam")).collect()}
    assert rows["q"]["tags"] == {"NM": "1", "XX": "a:b"} and rows["z"]["tags"] == {} and rows["z"]["chrom"] is None
    (tmp_path / "a.vcf").write_text("##x\nchr1\t3\ta\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL\tGT:DP:GT\t0/1:7:1/1\n")
    assert tables.read_vcf(spark, str(tmp_path / "a.vcf")).first()["fmt"] == {"GT": "0/1", "DP": "7"}


def test_written_parts_joined_by_name_are_sorted(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"chr{r.choice([1, 2, 10, 22])}", r.randint(1, 10**6), "DEL", -5, "0/1") for _ in range(500)] + [("chrX", 5, "INS", 7, "1/1")]
    tables.write_vcf(spark.createDataFrame(rows, "chrom string, pos long, svtype string, svlen long, gt string").repartition(6), str(tmp_path / "v"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*"))).splitlines()
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    assert lines[0] == "##fileformat=VCFv4.2" and lines[len(lines) - len(body) - 1].startswith("#CHROM") and len(body) == 501
    keys = [(int(x[0][3:]) if x[0][3:].isdigit() else 10**6, int(x[1])) for x in body]
    assert keys == sorted(keys)
    beds = [(c, p, p + 9) for c, p, *_ in rows]
    tables.write_bed(spark.createDataFrame(beds, "chrom string, start long, end long").repartition(6), str(tmp_path / "b"))
    lines = [x.split("\t") for p in sorted((tmp_path / "b").glob("part-*")) for x in p.read_text().splitlines()]
    assert [(c, int(a), int(b)) for c, a, b in lines] == sorted(beds)
