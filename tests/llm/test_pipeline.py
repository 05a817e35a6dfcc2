from __future__ import annotations

import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from skysieve.llm import shingle_copies
from skysieve.llm.simhash_ball import simhash_components
from tests_support import SF, write_tables

from skysieve.llm.factorisation import quality_scores


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_stages_follow_each_other(spark, docs_of, tmp_path):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(260):
        body = [rng.choice(words) for _ in range(rng.randint(30, 60))]
        text = " ".join(body)
        if i % 6 == 0:
            text = " | ".join(body)
        labels.append((i, int(i % 6 > 0), 0))
        rows.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
    rows += [(1000 + i, rows[1][1].replace(" ", "  "), "en", "a", 9) for i in range(40)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (None, "no id " * 20, "en", "b", 1)]
    sf_dir = write_tables(tmp_path, docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema, seen = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before.collect(), docs.collect()
        if name != "packing":
            assert docs.schema == schema
    before, after = seen["quality"]
    scored = quality_scores(spark.createDataFrame(before, schema), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in scored if r.predicted)
    before, after = seen["exact_dedup"]
    assert Counter(plain(r.text) for r in after) == Counter({plain(r.text) for r in before})
    before, after = seen["near_dedup"]
    groups = simhash_components(spark.createDataFrame(before, schema)).collect()
    assert sorted((r.doc_id for r in after), key=str) == sorted({r.component_id for r in groups}, key=str)
    before, after = seen["mixing"]
    total = sum(len((r.text or "").split()) for r in before)
    assert abs(sum(len((r.text or "").split()) for r in after) - 1.5 * total) < 5
    before, after = seen["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r.length for r in after) == want


def test_run_gives_the_last_stage(spark):
    result = corpus_pipeline.run(spark, SF)
    assert set(result.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and result.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_empty_tables(spark, docs_of, tmp_path):
    sf_dir = write_tables(tmp_path, docs_of([]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, sf_dir).collect() == []


def test_simhash_finds_near_copies_without_bands(spark, docs_of, tmp_path, monkeypatch):
    rooms = shingle_copies._rooms
    monkeypatch.setattr(shingle_copies, "_rooms", lambda members, turn: rooms(members, turn).limit(0))
    line = [f"w{i}" for i in range(40)]
    texts = {
        5: " ".join(line * 60), 6: " ".join(line * 60 + ["new"]),  # 40 of 46 shingles
        7: " ".join(line * 60 + ["other"]), 9: " ".join(line[::-1]),
        4: None, 3: "",
    }
    docs = docs_of([(i, t, "en", "a", 1) for i, t in texts.items()] + [(None, texts[9], "en", "a", 1)])
    by_simhash = {r.doc_id: r.component_id for r in simhash_components(docs).collect()}
    assert {by_simhash[i] for i in (5, 6, 7)} == {5}
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [3, 5, 9]
