import zlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from veriquill.llm import mixing
from veriquill.llm.toxicity import fit_toxicity, score_toxicity

from .fixtures import frame, prose, texts
from .test_text_operators import labelled, plain_components, plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, folder):
    rows, labels = labelled(spark)
    rows = [r for r in texts() if r[0] != 13] + [(i + 1000, t) for i, t in rows] + [(3000 + k, "write to a.b@c.de or 10.0.0.1 " + prose(900 + k, 60)) for k in range(5)]
    docs = frame(spark, rows).select(*COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.selectExpr("doc_id + 1000 as doc_id", "toxic", "quality").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_stages_take_effect(spark, tmp_path):
    docs, labels = tables(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: spark.createDataFrame(stages[name](spark, df, str(tmp_path)).collect(), docs.schema)
    clean = step("toxicity", docs)
    scored = {(r.doc_id, r.predicted) for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()}
    assert clean.columns == COLUMNS and Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in docs.collect() if (r.doc_id, 0) in scored)
    assert sum(p for _, p in scored) >= 90
    one = step("near_duplicates", clean)
    prints = {r.doc_id: plain_fingerprint(r.text) for r in clean.collect() if r.doc_id is not None}
    root, smallest = plain_components(list(dict.fromkeys(prints.values()))), {}
    for i, fp in prints.items():
        smallest[root[fp]] = min(i, smallest.get(root[fp], i))
    heads = set(smallest.values())
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == sorted(heads)
    safe = step("personal_data", one)
    before = {r.doc_id: r for r in one.collect()}
    for r in safe.collect():
        assert "a.b@c.de" not in (r.text or "") and r.n_chars == (None if r.text is None else len(r.text))
        if r.doc_id is None or r.doc_id < 3000:
            assert r.text == before[r.doc_id].text
    mixed = step("mixing", safe)
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, safe.collect()))
    pieces = stages["packing"](spark, mixed, str(tmp_path)).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*encoder.encode(r.text or "", add_special_tokens=False).ids, 1] for r in mixed.collect()}
    assert {r.doc_id for r in pieces} == ids.keys()
    for r in pieces:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert Counter(map(key, whole)) == Counter(map(key, pieces))


def test_stages_on_empty_tables(spark, tmp_path):
    docs, labels = tables(spark, str(tmp_path / "full"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_sequences_follow_the_mixture(spark, tmp_path):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(350)), lambda k: F.concat(F.lit("w"), (F.col("id") * k) % 97)))
    source = F.when(F.col("id") % 10 < 3, 0).otherwise(1 + F.floor(F.col("id") / 10) % 20).cast("string")
    rows = spark.range(0, 12_000, 1, 6).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), source).alias("source"), F.lit(0).alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/unmixed")
    stages, unmixed = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/unmixed")
    stages["mixing"](spark, unmixed, str(tmp_path)).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    of = {r.doc_id: r.source for r in unmixed.select("doc_id", "source").collect()}

    def shares(docs):
        """Per 300 consecutive sequences, the share of ids that come from src0."""
        pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
        assert {r.doc_id for r in pieces} == of.keys() and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
        ids = sorted({r.sequence_id for r in pieces})
        place, first, total = {s: k // 300 for k, s in enumerate(ids)}, Counter(), Counter()
        for r in pieces:
            total[place[r.sequence_id]] += r.length
            first[place[r.sequence_id]] += r.length * (of[r.doc_id] == "src0")
        return [first[k] / total[k] for k in sorted(total)], {(r.doc_id, r.start, r.sequence_id) for r in pieces}, ids

    got, pieces, ids = shares(mixed)
    assert {i >> 31 for i in ids} == {0, 1, 2}
    half = len(got) // 2  # no source has run out
    assert half >= 3 and all(abs(x - 0.2) < 0.05 for x in got[:half]), got
    plain, others, _ = shares(unmixed)
    assert all(abs(x - 0.3) < 0.05 for x in plain[:half]) and pieces != others


def test_ranks_are_those_of_the_layout(spark, tmp_path):
    docs = frame(spark, texts() + [(5000 + k, prose(k, 50)) for k in range(300)]).select(*COLUMNS)
    want = mixing.schedule(docs, {"a": 3, "b": 1, "*": 2}, block_bytes=2000).orderBy("mix_slot", "mix_start", "doc_id").collect()
    laid = mixing.mix(docs, {"a": 3, "b": 1, "*": 2}, block_bytes=2000)
    laid.write.option("maxRecordsPerFile", 20).parquet(f"{tmp_path}/laid")
    got = sorted(mixing.ranked(spark.read.parquet(f"{tmp_path}/laid")).collect(), key=lambda r: r.mix_rank)
    assert [r.mix_rank for r in got] == list(range(docs.count()))
    assert [r.doc_id for r in got if r.doc_id is not None and r.doc_id >= 5000] == [r.doc_id for r in want if r.doc_id is not None and r.doc_id >= 5000]
    assert mixing.ranked(docs.limit(0)).collect() == []
