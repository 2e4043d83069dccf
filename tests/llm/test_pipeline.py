"""The pipeline's stages against plain versions, one after the other."""
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.test_near import FOLD, components_by_hand, simhash_by_hand
from tidewatch.llm.queries import mixed

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack"]
    frames = [docs]
    for _, stage in pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    assert all(f.columns == docs.columns for f in frames[:-1])
    rows = [f.collect() for f in frames]
    # no document whose language is plain is lost
    assert {r.doc_id for r in rows[0]} - {r.doc_id for r in rows[1]} <= {r.doc_id for r in rows[0] if len(r.text) < 40}
    last = {}
    for r in rows[1]:
        last[r.text.translate(FOLD)] = max(r.doc_id, last.get(r.text.translate(FOLD), -1))
    assert {r.doc_id for r in rows[2]} == set(last.values())
    fps = {r.doc_id: simhash_by_hand(r.text) for r in rows[2]}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert {r.doc_id for r in rows[3]} == set(components_by_hand(fps, links).values())
    assert {r.doc_id for r in rows[4]} == {r.doc_id for r in mixed(frames[3]).collect() if r.kept}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows[5]}
    want = {}
    for r in rows[4]:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            data = b"".join(i.to_bytes(4, "little") for i in ids[k:k + 2048])
            want[r.doc_id, k // 2048] = (k, len(data) // 4, zlib.crc32(data))
    assert pieces == want and len({r.sequence_id for r in rows[5]}) <= -(-sum(r.length for r in rows[5]) // 2048) + 2


def test_run_gives_what_the_stages_give(spark):
    got = {(r.doc_id, r.piece, r.ids_crc32) for r in pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert got == {(r.doc_id, r.piece, r.ids_crc32) for r in docs.collect()}


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_documents(spark, odd_docs):
    docs, size = odd_docs, odd_docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == odd_docs.columns and docs.count() <= size
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_unlisted_sources_and_languages_are_mixed(spark):
    docs = spark.range(8_000).selectExpr("id AS doc_id", "concat(repeat('some words of prose here ', 20), id) AS text",
                                         "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'it' ELSE 'en' END AS lang",
                                         "CASE id DIV 4 % 4 WHEN 0 THEN NULL WHEN 1 THEN 'new' ELSE concat('src', id DIV 16 % 20) END AS source")
    kept = {(r.lang, r.source): r["count"] for r in pipeline.mix_sources(spark, docs, SF).groupBy("lang", "source").count().collect()}
    assert all(kept.get((lang, source), 0) > 0 for lang in (None, "it", "en") for source in (None, "new", "src2"))
    n = sum(kept.values())
    for at in (0, 1):
        assert abs(sum(k for v, k in kept.items() if v[at] in (None, "it", "new")) / n - 0.5) < 0.05
    # nothing listed on an axis: the rest is drawn alike, whether or not one listed document is there
    none = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "'new' AS source")
    one = none.selectExpr("doc_id", "text", "if(doc_id = 5, 'en', lang) AS lang", "if(doc_id = 5, 'src1', source) AS source")
    assert pipeline.mix_sources(spark, none, SF).count() == 8_000
    assert pipeline.mix_sources(spark, one, SF).count() > 7_900
