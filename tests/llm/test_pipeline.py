import collections

import corpus_pipeline as cp
from edgeproof.llm import fm_decontamination, quality_qda
from edgeproof.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.lower().encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    rows = [{r["doc_id"]: r for r in docs.collect()}]
    for name, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, SF), name)
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        rows.append({r["doc_id"]: r for r in docs.collect()})
    whole, good, once, cut, clean = rows
    scores = quality_qda.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(good) == {r["doc_id"] for r in scores if r["score"] >= 0.3}
    s = {i: shingles(r["text"]) for i, r in good.items()}
    alike = lambda a, b: len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])
    ids = sorted(once)
    assert not any(alike(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    assert all(any(alike(a, b) for b in good if b < a) for a in set(good) - set(once))
    assert set(cut) == set(once)
    count = collections.Counter(t[i : i + cp.PASSAGE] for r in once.values() for t in [r["text"].encode()] for i in range(len(t) - cp.PASSAGE + 1))
    for i, r in once.items():
        t = r["text"].encode()
        gone = bytearray(len(t))
        for k in range(len(t) - cp.PASSAGE + 1):
            if count[t[k : k + cp.PASSAGE]] > 1:
                gone[k : k + cp.PASSAGE] = b"\1" * cp.PASSAGE
        if not any(gone):
            assert cut[i]["text"] == r["text"]
        else:
            assert len(cut[i]["text"].encode()) <= len(t) - sum(gone) and cut[i]["n_chars"] == len(cut[i]["text"])
    verdict = {r["id"]: r["contaminated"] for r in fm_decontamination.contamination(spark.createDataFrame(list(cut.values()), docs.schema), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(clean) == {i for i, bad in verdict.items() if not bad}
    mix = cp.STAGES[-1][1](spark, docs, SF)
    assert set(docs.columns) <= set(mix.columns) and {r["doc_id"] for r in mix.collect()} <= set(clean)


def test_stages_on_awkward_tables(spark, awkward, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x y z"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (awkward, empty):
        for name, stage in cp.STAGES:
            docs = cp.written(stage(spark, docs, str(tmp_path)), name)
        assert {*awkward.columns, "mix_pass", "mix_shard"} == {*docs.columns}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
