import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.conftest import SF
from tests.llm.test_near_dedup import brute


def stage(name, spark, docs):
    out = dict(P.STAGES)[name](spark, docs, SF)
    if name != "packing":
        assert out.columns == P.COLUMNS
    return out


def test_stages_against_brute_force(spark, documents):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = documents
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    left = {r.doc_id for r in stage("toxicity", spark, docs).collect()}
    assert len(toxic & left) <= 0.4 * len(toxic) and len(clean - left) <= 0.02 * len(clean)

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = {}
    for key, text in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), key)
    once = stage("exact_dedup", spark, docs)
    assert {r.doc_id for r in once.collect()} == set(first.values())

    rows = [(r.doc_id, r.text) for r in once.collect()]
    near = stage("near_dedup", spark, once)
    assert {r.doc_id for r in near.collect()} == {k for k, _, c in brute(rows) if k == c}

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    mixed = stage("mixing", spark, near).collect()
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    total = sum(size(r.text) for r in near.collect())
    assert 0.9 * total <= sum(size(r.text) for r in mixed) <= total

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stage("packing", spark, spark.createDataFrame(mixed, documents.schema)).collect()
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(p.length for p in pieces) == want


def test_edges(spark, edge, nothing):
    typed = lambda df: df.selectExpr("*", "cast(length(text) AS long) n_chars")
    for docs in (typed(edge), typed(nothing)):
        for name, _ in P.STAGES:
            docs = spark.createDataFrame(stage(name, spark, docs).collect(), stage(name, spark, docs).schema)


def test_decisions_hold_for_their_row_alone(spark):
    """Repeated and missing ids: neither drags another row along nor stays for want of an id."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "same text here"), (1, "same text here"), (None, "same  text here"), (1, long), (None, long + " x"),
            (2, "another text"), (2, None), (None, None), (3, "third")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    once = stage("exact_dedup", spark, docs)
    left = sorted(((r.doc_id, r.text) for r in once.collect()), key=repr)
    assert left == sorted([(1, "same text here"), (1, long), (None, long + " x"), (2, "another text"), (2, None), (3, "third")], key=repr)
    once = spark.createDataFrame(once.collect(), docs.schema)
    near = [(r.doc_id, r.text) for r in stage("near_dedup", spark, once).collect()]
    assert sorted(near, key=repr) == sorted(set(left) - {(None, long + " x")}, key=repr)


def test_run_leaves_the_callers_session_as_it_is(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    own = P._own_session(spark)
    assert spark.conf.get(name) == before and own.conf.get(name) == str(P.BATCH_ROWS)
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
