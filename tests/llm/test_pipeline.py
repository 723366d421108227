import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from archspan.llm import common, lines, packing, quality, secrets, wordbpe

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are missing")


def plain_lines(docs):
    """Text by id after the line dedup, by dictionaries."""
    pages, seen = Counter(d["source"] for d in docs), Counter()
    for d in docs:
        seen.update({(d["source"], x) for x in d["text"].split("\n") if x.strip(" ")})
    bad = {k for k, n in seen.items() if n >= lines.LEAST and 100 * n > lines.PERCENT * pages[k[0]]}
    return {d["doc_id"]: "\n".join(x for x in d["text"].split("\n") if (d["source"], x) not in bad) for d in docs}


def plain_kept(docs):
    """Ids that stay after the near-duplicate stage, by comparing all pairs."""
    sets = {}
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"]))
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if label[a] != label[b] and x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, old = sorted((label[a], label[b]))
                label = {k: low if v == old else v for k, v in label.items()}
    return {i for i in ids if label[i] == i}


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = common.durable(stage(spark, docs, SF), "test")
        after = [r.asDict() for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "quality_classifier":
            label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            learned = [d for d in sorted(before, key=lambda d: str(d["doc_id"])) if d["doc_id"] in label and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2]
            model = quality.grow(np.array([quality.statistics(d["text"]) for d in learned]), np.array([float(label[d["doc_id"]]) for d in learned]))
            score = model.score(np.array([quality.statistics(d["text"]) for d in before]))
            assert {d["doc_id"] for d in after} == {d["doc_id"] for d, s in zip(before, score, strict=True) if s >= quality.THRESHOLD}
        elif name == "line_dedup":
            assert {d["doc_id"]: d["text"] for d in after} == plain_lines(before) and all(d["n_chars"] == len(d["text"]) for d in after)
        elif name == "near_duplicates":
            assert {d["doc_id"] for d in after} == plain_kept(before) and len(after) < len(before)
        elif name == "secret_scans":
            assert {d["doc_id"]: d["text"] for d in after} == {d["doc_id"]: secrets.redacted(d["text"]) for d in before}
        else:
            ids = wordbpe.word_ids()([d["text"] for d in before])
            want = sorted((d["doc_id"], k, min(4096, len(x) // 4 + 1 - s)) for d, x in zip(before, ids, strict=True) for k, s in enumerate(range(0, len(x) // 4 + 1, 4096)))
            assert sorted((r["doc_id"], r["piece"], r["length"]) for r in after) == want
            assert len({r["sequence_id"] for r in after}) == len([1 for _, n in packing.patterns(Counter(x for *_, x in want)) for _ in range(n)])


def test_one_of_a_group_of_copies_stays_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL")
    source = docs.groupBy("source").count().orderBy("count", "source").first()["source"]
    exact, base = ("\n".join(" ".join(f"{a}{i}x{j}" for j in range(30)) for i in range(8)) for a in "pq")
    near = [base.replace(f"q{k % 8}x7", f"r{k}") for k in range(40)]
    more = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate([exact] * 40 + near)], "doc_id long, text string")
    more = docs.where(docs.source == source).limit(1).drop("doc_id", "text", "n_chars").crossJoin(more.withColumn("n_chars", F.char_length("text")))
    docs = docs.unionByName(more.select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_duplicates):
        docs = common.durable(stage(spark, docs, SF), "copies")
    left = [r["text"] for r in docs.where("doc_id >= 1000000000").collect()]
    assert left.count(exact) == 1 and sum(t in near for t in left) == 1 and "" not in left


LONG = "A long text has many words, and none of them is a secret. " * 20_000
COPY = " ".join(f"word{i}" for i in range(40))
CASES = [(1, None), (2, ""), (3, " "), (None, COPY), (None, COPY), (4, LONG), (4, "Another text under the same id is a document of its own, it is said."), (5, COPY), (5, COPY), (6, COPY + " more"), (7, "token=abcdefgh12345 x"), (8, "x\ny\nz")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row int, score double, component_id string, kept boolean, piece int"


def folder(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_on_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    sf = folder(spark, tmp_path, [(1, None, 0)])  # no label to learn from: all documents stay
    docs = spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, k, 0.5, "c", False, 3) for k, (i, t) in enumerate(CASES)], SCHEMA)
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality_classifier", "line_dedup", "secret_scans", "near_duplicates"):
        out = common.durable(stages[name](spark, docs.drop("__row") if name == "near_duplicates" else docs, sf), "cases")
        assert out.columns == [c for c in docs.columns if name != "near_duplicates" or c != "__row"]
        if name == "near_duplicates":  # of COPY and COPY + " more" the row of the least id stays, once
            assert key(out) == sorted([c for c in CASES if not (c[1] or "").startswith(COPY)] + [(5, COPY)], key=str)
        elif name == "secret_scans":
            assert key(out) == sorted([(i, "token=[REDACTED] x" if i == 7 else t) for i, t in CASES], key=str)
        else:
            assert key(out) == sorted(CASES, key=str)
    packed = stages["best_fit_packing"](spark, docs, sf).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(CASES) and sum(r["length"] == 1 for r in packed) == 3
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_rejected_documents_go_and_one_label_alone_rejects_none(spark, tmp_path):
    good = [f"The cat number {i} sat on the mat. It was a fine day." for i in range(80)]
    bad = [f"|| x{i} || y || z || ||" for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(good + bad)) + [(3, bad[0]), (None, bad[1]), (None, good[1])], "doc_id long, text string")
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    both = folder(spark, tmp_path / "a", [(i, int(i < 80), 0) for i in range(160)])
    out = sorted(r["text"] for r in corpus_pipeline.quality_classifier(spark, docs, both).collect())
    assert out == sorted([*good, good[1]])
    one = folder(spark, tmp_path / "b", [(i, 0, 0) for i in range(160)])
    assert corpus_pipeline.quality_classifier(spark, docs, one).count() == docs.count()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
