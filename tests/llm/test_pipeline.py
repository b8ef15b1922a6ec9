"""The pipeline stage by stage on the small tables."""

import re

import corpus_pipeline
from cohortspark.llm.queries import word_bpe
from cohortspark.llm.runtime import save

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = save(stage(spark, docs, SF))
        sizes.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
            assert docs.exceptAll(before).count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.4 * sizes[0]
    kept = {r.doc_id for r in docs.collect()}
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [word.findall(r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {" ".join(i[k : k + 10]) for i in items for k in range(max(1, len(i) - 9))}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len({texts[i].lower() for i in kept}) == len(kept)
    for i in kept:
        w = word.findall(texts[i].lower())
        assert not windows & {" ".join(w[k : k + 10]) for k in range(len(w))}
    assert word_bpe().endswith("word_bpe_49k.json")


def test_odd_rows(spark):
    """Null ids and texts, empty texts, repeated rows and clashing columns in every stage; empty tables too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    extra = ["score", "row", "root", "n", "key", "id", "label", "near_place", "ids", "tokens"]
    rows = [(*d, *[1] * len(extra)) for d in docs]
    rows += [(None, docs[0].text, "en", "s", 1, *[2] * len(extra)), (9001, None, None, None, None, *[None] * len(extra)), (9002, "", "en", "s", 0, *[3] * len(extra))]
    rows += [rows[3], rows[3], (9003, "x " * 30_000, "en", "s", 60_000, *[4] * len(extra))]
    kinds = spark.read.parquet(f"{SF}/documents.parquet").schema.simpleString()[7:-1].replace(":", " ")
    frame = save(spark.createDataFrame(rows, kinds + "".join(f", {c} int" for c in extra)))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        got = out.collect()
        assert len(got) <= len(rows)
        if name == "tokens":
            assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        else:
            assert out.columns == frame.columns and out.exceptAll(frame).count() == 0
        if name in ("quality", "toxicity", "decontamination"):  # repeated rows share their fate
            assert sum(r.doc_id == rows[3][0] for r in got) in (0, 3)
        if name == "near_duplicates":
            assert sum(r.doc_id == rows[3][0] for r in got) <= 1 and sum(not (r.text or "").strip() for r in got) == 1
        assert stage(spark, frame.limit(0), SF).count() == 0
