"""The pipeline stage by stage against brute force, on a table with nulls, copies and clashing columns."""

import random

import pytest

import corpus_pipeline

from .test_llm import shingles, words

KINDS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept_id string, cut_id long, row_key long, rank string"
INSULTS = ["grumpf", "blarg", "snork"]


def corpus():
    r = random.Random(41)
    rows, labels = [], []

    def add(text, source="a", i=None):
        i = len(rows) if i is None else i
        rows.append((i, text, "en", source, None if text is None else len(text), "x", "y", 3, 4, "z"))
        return i

    for k in range(900):
        w = words(r.randint(12, 50), r).split()
        toxic = r.random() < 0.25
        if toxic:
            w[4:4] = r.sample(INSULTS, 2)
        i = add(" ".join(w), "abc"[k % 3])
        if k < 800:
            labels.append((i, int(r.random() < 0.7), int(toxic)))
    passage, base = words(70, r), words(200, r).split()
    for k in range(6):
        add(words(20, r) + " " + passage + "\n" + words(20, r), "b")
        near = list(base)
        near[10 + 25 * k] = f"changed{k}"
        add(" ".join(near), "c")
    add(" ".join(base), "c")
    add(passage)  # loses all its words
    add(None), add(""), add(" \n")
    add("words without a source " + words(30, r), None)
    rows.append((None, "no id " + words(60, r), None, "a", None, None, None, None, None, None))
    rows.append(rows[3])  # a repeated row
    add(words(60, r), "a", i=5)  # another text under a known id
    return rows, labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, labels = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def count(rows):
    out = {}
    for r in rows:
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, sf_dir)
        after = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame(after, docs.schema)
        seen[name] = (before, after, docs.columns)
    for name in ("toxicity", "minhash near-dedup", "substring dedup", "mixing"):
        assert seen[name][2] == [c.split()[0] for c in KINDS.split(", ")]

    before, after, _ = seen["toxicity"]
    want = [r for r in before if not any(w in (r[1] or "").split() for w in INSULTS)]
    assert count(after) == count(want) and len(after) < len(before)

    before, after, _ = seen["minhash near-dedup"]
    sets = [shingles(r[1]) for r in before]
    ids = [r[0] for r in before]
    parent = list(range(len(before)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in range(len(before)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if ids[a] is not None and ids[b] is not None and (ids[a] == ids[b] or sets[a] and sets[b] and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common)):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    low = {}
    for a, i in enumerate(ids):
        if i is not None:
            low[root(a)] = min(i, low.get(root(a), i))
    want = [r for a, r in enumerate(before) if ids[a] is None or low[root(a)] == ids[a]]
    assert count(after) == count(want) and len(before) - len(after) == 6

    before, after, _ = seen["substring dedup"]
    first, want = {}, []
    for r in sorted(before, key=lambda r: (r[0] is None, r[0])):
        w = (r[1] or "").split()
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if r[0] is not None and first.setdefault(tuple(w[a : a + 50]), r[0]) < r[0]:
                gone[a : a + 50] = [True] * 50
        if any(gone):
            text = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
            r = (r[0], text, *r[2:4], len(text), *r[5:])
        if not gone or not all(gone):
            want.append(r)
    assert count(after) == count(want)
    assert sum(len((r[1] or "").split()) for r in before) - sum(len((r[1] or "").split()) for r in after) >= 6 * 70

    before, after, _ = seen["mixing"]
    assert set(after) <= set(before)
    sizes, got = ({s: sum(len((r[1] or "").split()) for r in x if r[3] == s) for s in ["a", "b", "c", None]} for x in (before, after))
    total, stopped = sum(sizes.values()), 3 * sizes[None]
    for weight, s in ((1, "a"), (2, "b"), (3, "c")):
        assert abs(got[s] - (total - stopped) * weight / 6) <= 100
    assert got[None] == stopped

    before, after, _ = seen["packing"]
    assert sum(r[3] for r in after) == sum(len((r[1] or "").split()) for r in before)
    bins = {}
    source = {r[0]: r[3] for r in before}
    for doc, _, _, size, shard, number, fill in after:
        if number >= 0 and shard >= 0:
            bins.setdefault((shard, number), []).append((doc, size, fill))
    for members in bins.values():
        assert sum(m[1] for m in members) == members[0][2] <= 2048
        for kinds in ([m[0] for m in members if m[0] is not None], [source[m[0]] for m in members if source[m[0]] is not None]):
            assert len(kinds) == len(set(kinds))
    assert len(bins) <= 1.1 * max(sum(r[3] == s for r in before) for s in "abc") + 5  # one document of a source a bin


def test_run_gives_what_its_stages_give(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "piece", "start", "size", "shard", "bin", "fill"] and found.count() > 150


def test_empty_tables_pass(spark, tmp_path):
    spark.createDataFrame([], KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
