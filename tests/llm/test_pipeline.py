"""The pipeline's stages against plain versions, and the registered queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import DOCS
from tests.llm.test_near_copies import similarity
from tests.llm.test_texts import EMAIL, plain_base
from webframe.llm import packing, queries
from webframe.llm.oracle import ORACLE
from webframe.llm.shared import stored

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(queries.QUERIES) & set(entry.oracle_sql())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def linked(texts):
    """The smallest id that links of five-word shingles, four fifths of them shared, reach from each id."""
    root = {i: i for i in texts}
    for i, t in texts.items():
        for j, u in texts.items():
            if j < i and root[i] != root[j] and similarity(t, u) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_stages(spark, docs):
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, kept, SF), "stage")
        texts[name] = ({r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}, out)
        if name != names[-1]:
            assert out.columns == columns
        kept = out

    def after(name):
        return {r.doc_id: r.text for r in texts[name][1].select("doc_id", "text").collect()}

    before = texts["exact_dedup"][0]
    best = {}
    for i, t in before.items():
        best[t] = max(i, best.get(t, i))
    assert after("exact_dedup") == {i: t for t, i in best.items()}
    before = texts["simhash_near_dedup"][0]
    root = linked(before)
    assert after("simhash_near_dedup") == {i: before[i] for i in before if root[i] == i}
    assert len(before) > len(after("simhash_near_dedup"))
    before = texts["personal_data"][0]
    clean = after("personal_data")
    assert set(clean) == set(before)
    for i, t in before.items():
        assert (clean[i] == t) == (not plain_base(t)) and not EMAIL.search(clean[i])
    packed = texts["packing"][1]
    total = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert total.filter(f"n != end or n > {packing.CAPACITY}").count() == 0
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(clean)


def test_personal_data_stage_leaves_nothing_out(spark):
    texts = {
        "call +1 (269) 555-3296 4524132264652876 and on": "call [PHONE] [CARD] and on",
        "e 27.204.213.132 4116106959541135\nnext 4451718024887799 27.65.93.188": "e [IP] [CARD]\nnext [CARD] [IP]",
        "thst token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" with": "thst token = \"[SECRET]\" with",
        "and password=b7db7aa4a5fcc78305 en": "and password=[SECRET] en",
        "{'db_password': 'correct-horse'} a.b@c.de": "{'db_password': '[SECRET]'} [EMAIL]",
        "a token: something short, password=unknown, key = 123456789 b=9807915762804490": None,
    }
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = corpus_pipeline.personal_data_stage(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    want = [new or old for old, new in texts.items()]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == [(i, t, len(t)) for i, t in enumerate(want)]


def test_stages_take_empty_and_odd_tables(spark, odd, none):
    for table in (none, odd.select("doc_id", "text", "lang", "source", "n_chars", "kept", "fp")):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), "stage")
        assert docs.count() == 0  # all odd rows have too few words
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd, SF).count() >= 5


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
