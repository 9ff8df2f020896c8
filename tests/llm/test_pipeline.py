"""The pipeline, stage by stage, against plain Python."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from emberlog.llm import quality_classifier, secret_scan
from emberlog.llm.store import written
from test_dedup import near_by_hand

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), f"test-{name}")
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "secret_scan", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = quality_classifier.score(stages[0], quality_classifier.fit(stages[0], labels)).filter("predicted = 1")
    assert ids(stages[1]) == ids(good)


def test_exact_and_near(stages):
    first = {}
    for r in sorted(stages[1].collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert ids(stages[2]) == set(first.values())
    roots = near_by_hand([(r.doc_id, r.text) for r in stages[2].collect()], 5, 80)
    assert ids(stages[3]) == {i for i, (_, root) in roots.items() if i == root}


def test_secrets_and_packing(stages):
    forest = secret_scan.fit()
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[3:5])
    assert set(before) == set(after)
    for i, r in before.items():
        text = r.text
        if text is not None:
            for start, end in reversed(secret_scan.joined(secret_scan.scan_texts([text], forest)[0])):
                text = text[:start] + secret_scan.MASK + text[end:]
        assert after[i].text == text and (text is None or after[i].n_chars == len(text))
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    lengths = {}
    for r in stages[5].collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in after.items()}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null ids and texts, ids that repeat with equal and with other texts, clashing names, a long text; and as many labels."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi").orderBy("doc_id").limit(40)
    texts = [r.text for r in some.collect()]
    bad = [r.text for r in docs.join(labels.filter("quality = 0"), "doc_id", "left_semi").orderBy("doc_id").limit(3).collect()]
    long = " ".join(texts) * 20
    rows = [(7, texts[0]), (7, texts[0]), (7, texts[1]), (5, texts[1]), (None, texts[2]), (None, texts[2]), (None, None), (1, None), (1, None), (2, ""), (3, long), (4, texts[3] + "  "), (4, texts[3]), (4, bad[0]), (None, bad[1]), (8, texts[4]), (9, texts[4] + " and a few words more")]
    made = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
    clash = ["score", "entry", "row", "sha", "node", "keys", "_id", "_th", "c0", "label", "held_out", "stays"]
    made = made.withColumns({c: F.lit(k) for k, c in enumerate(clash)})
    made.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder, docs, bad


def test_stages_on_odd_rows(spark, odd):
    folder, docs, bad = odd
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    scores = quality_classifier._scorer(docs, quality_classifier.fit(docs, labels))
    rows = [tuple(r) for r in table.collect()]
    # the classifier as fitted on labelled documents, each row by its own text
    import pyarrow as pa

    good = [r for r in rows if scores(pa.array([r[1] or ""]))[0] >= quality_classifier.THRESHOLD]
    assert not any(r[1] in bad for r in good) and len(good) > 8
    fine = spark.createDataFrame(good, table.schema)
    exact = written(corpus_pipeline.drop_exact_copies(spark, fine, folder), "test-exact")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in good:
        least.setdefault(norm(r[1]), []).append(r[0])
    want = sorted(((t, min((i for i in own if i is not None), default=None)) for t, own in least.items()), key=repr)
    assert sorted(((norm(r.text), r.doc_id) for r in exact.collect()), key=repr) == want and exact.dtypes == table.dtypes
    near = written(corpus_pipeline.drop_near_copies(spark, exact, folder), "test-near")
    kept = [r.text for r in near.collect()]
    assert near.dtypes == table.dtypes and len(kept) == len(set(kept)) and near.count() <= exact.count()
    clean = written(corpus_pipeline.mask_secrets(spark, near, folder), "test-secrets")
    assert clean.dtypes == table.dtypes and clean.count() == near.count()
    packed = corpus_pipeline.pack_sequences(spark, clean, folder)
    assert packed.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in packed.filter("start = 0").collect())


def test_stages_on_an_empty_table(spark, odd):
    folder, _, _ = odd
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, none, folder), f"empty-{name}")
        assert out.count() == 0 and (name == "packing" or out.dtypes == none.dtypes)
