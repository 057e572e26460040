"""The pipeline's stages against brute force on a small table."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers

import corpus_pipeline
from credenza.llm import sentencepiece_codec
from credenza.llm.common import save
from credenza.session import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append([(r.doc_id, r.text) for r in docs.collect()])
    start, kept, firsts, trimmed, mixed = seen
    assert all(brute.base_quality(t)[0] >= 20 for _, t in kept) and dict(kept).items() <= start.items()
    assert {d for d, _ in firsts} == {c for d, _, c in brute.components(kept) if c == d}
    cut = brute.repeated_words(firsts)
    assert {d: brute.words(t) for d, t in trimmed} == {d: [w for i, w in enumerate(brute.words(t)) if i not in cut.get(d, ())] for d, t in firsts}
    times = Counter(d for d, _ in mixed)
    assert max(times.values()) <= 3 and {(d, t) for d, t in mixed} <= set(trimmed)
    library = sentencepiece_codec.agenda(public_tokenizers.path("piece_bpe_32k.model")).library
    want = Counter((d, hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in [1, *library.encode(t), 2])).hexdigest()) for d, t in mixed)
    assert Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()) == want


def test_odd_and_empty_tables(spark, tmp_path):
    """Nulls, repeats, ids with several texts, a very long text and extra columns with clashing names; then nothing."""
    body, other = " ".join(f"word{i} and" for i in range(60)), " ".join(f"other{i} but" for i in range(70))
    data = [(1, None, None, None, None), (None, body, "en", "a", 1), (2, "", "en", None, 0), (3, body, "en", "b", 1), (3, body, "en", "b", 1), (4, body.upper(), None, None, 1), (4, other, "en", "a", 1), (5, " ".join(f"w{i * i % 99_991}" for i in range(40_000)), "en", "a", None), (None, " ".join(f"x{i} so" for i in range(40)), None, "a", 2)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 AS ids", "'s' AS node", "0 AS bucket", "9 AS id", "2.0 AS row")
    df.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = save(stage(spark, docs, ""), name)
        assert docs.columns == df.columns
    # The capitals of 4 are the text of 3 to the shingles; the long text is worth its base rules.
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text.split()[0]) for r in docs.collect()) == [(False, 3, "word0"), (False, 4, "other0"), (False, 5, "w0"), (True, 0, "x0")]
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in got} <= {3, 4, 5, None} and all(len(r.ids_sha256) == 64 for r in got)
    df.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
