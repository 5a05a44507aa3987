"""The corpus pipeline on a small corpus, held against brute force stage by stage."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_operators import ROWS, brute_fingerprint

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rest string, kept boolean, n_tokens int, row int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(8)
    words = [a + b for a in "ka lo mi nu pe".split() for b in "ra so ti vu".split()]
    rows = list(ROWS) + [(100 + i, " ".join(rng.choice(words) for _ in range(50)) + (" dreadful oaf dreadful" if i % 5 == 0 else ""), "en", f"s{i % 4}") for i in range(200)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "q", True, 1, 2) for r in rows], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i % 5 == 0), 1) for i in range(200)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def staged(spark, folder, docs, tmp_path):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append((name, docs))
    return out


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = staged(spark, corpus, docs, tmp_path)
    assert [n for n, _ in stages] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "best_fit_packing"]
    assert all(df.dtypes == docs.dtypes for _, df in stages[:-1])
    rows = {n: df.collect() for n, df in stages}
    assert Counter(r.doc_id for r in rows["toxicity"]) == Counter(r.doc_id for r in docs.collect() if "dreadful" not in (r.text or ""))

    fps = {(r.doc_id, r.text): brute_fingerprint(r.text) for r in rows["toxicity"]}
    group = {f: f for f in fps.values()}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in group:
        for b in group:
            if (a ^ b).bit_count() <= 2:
                group[root(a)] = root(b)
    best = {}
    for (d, t), f in fps.items():
        best[root(f)] = min(best.get(root(f), (True, 0, "")), (d is None, d or 0, t or ""))
    assert Counter(r.doc_id for r in rows["simhash_near_dedup"]) == Counter(None if n else d for n, d, _ in best.values())

    before = {r.doc_id: r.text or "" for r in rows["simhash_near_dedup"]}
    least, kept = {}, {}
    order = sorted(before, key=lambda d: (d is not None, d or 0))
    for d in order:
        b = before[d].encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if least.setdefault(b[k : k + 50], d) != d:
                gone[k : k + 50] = [True] * 50
        kept[d] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    after = {r.doc_id: r for r in rows["suffix_array_dedup"]}
    assert {d: r.text for d, r in after.items()} == {d: t for d, t in kept.items() if t or not before[d]}
    assert all(r.n_chars == len(r.text) for r in after.values())

    assert {r.doc_id for r in rows["mixing"]} == set(after)
    total = Counter()
    for r in rows["best_fit_packing"]:
        total[r.doc_id] += r.n_tokens
    sizes = Counter()
    for r in rows["mixing"]:
        sizes[r.doc_id] += len((r.text or "").encode())
    assert total == sizes


def test_run_and_empty_corpus(spark, corpus, tmp_path):
    assert corpus_pipeline.run(spark, corpus).count() > 0
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    assert [df.count() for _, df in staged(spark, corpus, docs, tmp_path)] == [0] * 5


def test_edited_copies_are_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(0, 60, 2):
        text = [rng.choice(words) for _ in range(120)]
        edited = list(text)
        for k in rng.sample(range(5, 115), i % 5):
            edited[k] = "new"
        rows += [(i, " ".join(text)), (i + 1, " ".join(edited).upper())]
    shingles = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(116)} for i, t in rows}
    close = {i for i in range(0, 60, 2) if len(shingles[i] & shingles[i + 1]) >= 0.8 * len(shingles[i] | shingles[i + 1])}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert any((fps[i] ^ fps[i + 1]).bit_count() > 2 for i in close) and len(close) < 30
    near = close | {i for i in range(0, 60, 2) if (fps[i] ^ fps[i + 1]).bit_count() <= 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or i - 1 not in near}
