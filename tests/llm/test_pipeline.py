import corpus_pipeline as pipe
import numpy as np
import pytest
from lakeplan.llm import decontam, mixing, tokenio, toxicity
from lakeplan.llm.common import table
from lakeplan.llm.queries import ORACLES, QUERIES

from .test_ngramjoin import brute_groups
from .test_tokenio import decoded


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    """The tables with the awkward rows of util added to documents."""
    from .util import DOCS

    path = tmp_path_factory.mktemp("tables")
    docs = table(spark, data, "documents")
    extra = spark.createDataFrame([(None if i is None else 10**6 + i, t, "en", "s", len(t or "")) for i, t in DOCS], docs.schema)
    docs.union(extra).coalesce(3).write.parquet(str(path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        (path / f"{name}.parquet").symlink_to(f"{data}/{name}.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    labels, bench = table(spark, folder, "labels"), table(spark, folder, "benchmark")
    whole = [(r.doc_id, r.text) for r in docs.collect()]
    run = lambda k, d: pipe.STAGES[k][1](spark, d, folder)
    save = lambda df, k: (df.write.parquet(f"{folder}/stage{k}"), spark.read.parquet(f"{folder}/stage{k}"))[1]

    clean = save(run(0, docs), 0)
    scored = toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()
    toxic = {r.doc_id for r in scored if r.is_toxic}
    assert clean.columns == columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in whole if i not in toxic) and 0 < len(toxic) < 0.3 * len(whole)

    kept = save(run(1, clean), 1)
    left = [(r.doc_id, r.text) for r in clean.collect()]
    groups, _ = brute_groups(left)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i, _ in left if groups.get(i, i) == i}

    pure = save(run(2, kept), 2)
    found = {r.doc_id for r in decontam.contaminated(kept, decontam.prepared(bench)).collect()}
    assert pure.columns == columns and {r.doc_id for r in pure.collect()} == {r.doc_id for r in kept.collect()} - found

    mixed = save(run(3, pure), 3)
    model = mixing.train(pure, labels, pipe.QUALITY)
    p = np.array([r.p for r in mixing.posteriors(mixed, model).collect()])
    n = np.array([r.n_tokens for r in mixing.posteriors(mixed, model).collect()], float)
    share = dict(zip(model.names, n @ p / n.sum()))
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in pure.collect()}
    assert all(abs(share[k] - pipe.SHARES[k]) < 0.05 for k in share)

    got, _ = decoded(run(4, mixed))
    assert sorted(got, key=str) == sorted(((r.doc_id, tokenio.encoder().encode_ordinary(r.text or "")) for r in mixed.collect()), key=str)


def test_run_gives_the_last_stage(spark, data):
    out = pipe.run(spark, data)
    assert out.columns == [c.split()[0] for c in tokenio.SCHEMA.split(", ")] and out.filter("block = -1").count() == 1
    assert [n for n, _ in pipe.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "token_blocks"]


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(names)
