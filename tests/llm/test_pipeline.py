"""The pipeline over a small corpus with planted cases: each stage's decisions take effect, clean documents stay."""

import random

import corpus_pipeline
from shutterlake.llm.queries import vocabulary
from shutterlake.llm.sentencepiece_codec import MergeCodec

COMMON = "the of and to a in is that it for was on with as be by".split()


def prose(seed, n=120):
    r = random.Random(seed)
    rare = [f"{a}{b}" for a in ("stone", "river", "cloud", "lamp", "field", "glass") for b in ("ing", "er", "ly", "ed", "ness", "less")]
    return " ".join(r.choice(COMMON) if r.random() < 0.35 else r.choice(rare) + r.choice("abcdefghij") for _ in range(n)) + "."


def test_each_stage_acts(spark, tmp_path):
    item = prose(999, 30)
    texts = {i: prose(i) for i in range(20)}
    texts[30] = texts[3]
    texts[31] = texts[4].replace("the ", "this ", 1)
    texts[40] = prose(40) + " " + item + " " + prose(41)
    texts[50] = prose(50) + " Write to jane.doe@mail.example.com or 10.20.30.40 now."
    texts[60] = "too short"
    texts[61] = "same line again and again here\n" * 40
    texts[62] = " ".join(w + "###" for w in prose(62).split())
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = set(texts)
    gone = {"quality": {60, 61, 62}, "near_duplicates": {30, 31}, "decontamination": {40}, "personal_data": set()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        kept -= gone[name]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r["doc_id"] for r in docs.collect()} == kept, name
    clean = {r["doc_id"]: r for r in docs.collect()}
    assert clean[50]["text"].endswith("Write to <EMAIL> or <IP> now.") and clean[50]["n_chars"] == len(clean[50]["text"])
    assert all(clean[i]["text"] == texts[i] for i in kept - {50})
    codec = MergeCodec(vocabulary("piece_bpe_32k.model"))
    out = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {i: len(codec.library.encode(clean[i]["text"])) + 1 for i in kept}
