"""Distances of many pairs at once against plain tables, and pairs that get their texts only once they are near."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from svspark.functions.edits import edits
from svspark.functions.scalars import edit_similarity
from svspark.operators import matching as M
from svspark.plans import adapters

from .conftest import SF
from .test_benchmark import CALL, ON, TRUTH
from .test_benchmark import edits as plain


def test_edits_of_many_pairs():
    rng = random.Random(1)
    pairs = [("", ""), ("", "ACG"), ("ACG", "ACG"), ("A" * 64, "A" * 65), ("é", "e"), ("😀A", "A")]
    for _ in range(400):
        letters = rng.choice(["ACGT", "AC", "ACGTN", "Aé😀", "abcdefghijklmnopq"])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 63, 64, 65, 128, 130, 200])))
        b = list(a) if rng.random() < 0.4 else [rng.choice(letters) for _ in range(rng.choice([1, 7, 64, 65, 129, 190]))]
        for _ in range(rng.randrange(6)):
            b.insert(rng.randrange(len(b) + 1), rng.choice(letters))
            del b[rng.randrange(len(b))]
        pairs.append((a, "".join(b)))
    assert edits(pairs).tolist() == [plain(a, b) for a, b in pairs]
    assert edits([(a.encode(), b.encode()) for a, b in pairs if (a + b).isascii()]).tolist() == [plain(a, b) for a, b in pairs if (a + b).isascii()]
    assert edits([]).tolist() == []


def test_edits_take_little_time():
    """By a table with a row for each letter these took minutes."""
    rng = random.Random(2)
    words = ["".join(rng.choices("ACGT", k=1500)) for _ in range(400)]
    began = time.process_time()
    assert (edits(list(zip(words[:-1], words[1:], strict=True))) > 600).all()
    assert time.process_time() - began < 20
    long = np.array(rng.choices(b"ACGT", k=20_000), np.uint8)
    assert edits([(long.tobytes(), long[::-1].tobytes())])[0] > 8000


def test_compared_is_edit_similarity(spark):
    rows = [(1, "ACGT", "acg"), (2, None, "A"), (3, "", ""), (4, "ß", "SS"), (5, "A", None), (6, "", "AC"), (7, "ACGTT", "TGCA")]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    want = {r[0]: r[1] for r in df.select("i", edit_similarity("a", "b")).collect()}
    assert {r[0]: r[1] for r in M.compared(df, ["i"], "a", "b", "s").collect()} == want


def test_rows_of_one_id_keep_their_texts(spark):
    calls = [("chr1", "INS", 1, 100, 200, "A" * 100), ("chr1", "INS", 1, 9000, 9100, "C" * 100), ("chr1", "INS", None, 100, 200, "A" * 90)]
    truth = [("chr1", "INS", 5, 100, 200, "A" * 100), ("chr1", "INS", 6, 9000, 9100, "C" * 50), ("chr1", "INS", 6, 9000, 9100, "G" * 100)]
    found = M.alike_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(truth, TRUTH), ON, sequence=0.0).collect()
    assert sorted((r[0] or 0, r[1], round(r[2], 4)) for r in found) == [(0, 5, round((180 / 190 + 2) / 3, 4)), (1, 5, 1.0), (1, 6, round((0.5 + 2) / 3, 4)), (1, 6, round((100 / 150 + 2) / 3, 4))]


def test_only_near_calls_are_spelled(spark):
    """Calls that no pair names go before their texts are joined to them."""
    texts = spark.createDataFrame([(7, "A" * 90), (8, "C" * 90)], "sid long, seq string")
    calls = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "cid long, sid long").join(texts, "sid", "left")
    found = M.with_texts(spark.createDataFrame([(1, 2), (3, 2), (9, 2)], "a long, b long"), calls, {"a": "cid"}, "seq", "s")
    assert sorted(map(tuple, found.collect())) == [(1, 2, "A" * 90), (3, 2, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Join LeftSemi")


def test_sequences_are_letters_as_bases(spark):
    d = adapters.table(spark, SF, "documents")
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    want = dict(d.select("doc_id", F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")).collect())
    assert dict(adapters.sequences(spark, SF).collect()) == want
    odd = spark.createDataFrame([(None,), ("",), ("K İé Zz",)], "text string")  # a Kelvin sign and a dotted I have letters in lower case
    assert [r[0] for r in odd.select(adapters._bases("text")).collect()] == ["", "", "GACC"]
