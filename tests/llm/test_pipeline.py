"""The pipeline's stages against brute force, on whole small tables."""

import re

import pytest
from helpers import CLASHES, ODD, docs
from test_decontaminate import brute as contaminated
from test_simhash import components, plain

import corpus_pipeline
from clarion.llm import toxicity

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_order_of_stages():
    assert list(STAGES) == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_run_is_the_stages_one_after_another(spark, table, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(table, labels)
    lexicon = toxicity.Lexicon(*model)
    rows = [r for r in sorted(table.collect(), key=lambda r: r.doc_id) if lexicon.score(r.text) < 0.5]
    kept = components([r.doc_id for r in rows], [plain(r.text) for r in rows])
    rows = [r for r, c in zip(rows, kept) if r.doc_id == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r, c in zip(rows, contaminated([r.text for r in rows], items)) if not c[-1]]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in rows}
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        assert sum(n for _, n in parts) <= 4096 and [o for o, _ in sorted(parts)][0] == 0


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_columns_and_clean_documents(spark, sf_dir, name):
    clean = [t for t in ODD if t != "same text here"]
    df = docs(spark, clean + ["same text here"], extra=CLASHES)
    out = STAGES[name](spark, df, sf_dir)
    assert out.columns == df.columns
    got = {r.doc_id for r in out.collect()}
    # Texts without words are near-duplicates of each other; everything else is kept by every stage.
    blank = {k for k, t in enumerate(clean) if not (t or "").strip()}
    assert got | blank == set(range(len(clean) + 1))
    assert STAGES[name](spark, docs(spark, []), sf_dir).count() == 0


def test_secrets_change_texts_only_at_credentials(spark, sf_dir, table):
    out = {r.doc_id: r.text for r in STAGES["secrets"](spark, table, sf_dir).collect()}
    whole = {r.doc_id: r.text for r in table.collect()}
    assert out.keys() == whole.keys()
    changed = [k for k in out if out[k] != whole[k]]
    for k in changed:
        parts = out[k].split("[SECRET]")
        assert len(parts) > 1 and re.fullmatch(".+".join(map(re.escape, parts)), whole[k], re.S)
