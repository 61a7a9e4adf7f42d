"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quarry.plans import code_oracles, code_queries, driver_oracles, driver_queries, function_queries, project_queries

ORACLES = driver_oracles.ORACLES | function_queries.ORACLES | project_queries.ORACLES | code_oracles.ORACLES
QUERIES = driver_queries.QUERIES | function_queries.QUERIES | project_queries.QUERIES | code_queries.QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(tables) / f"{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, tables, name):
    df = QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    got = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((plain(r) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)


def test_dup_similar_is_brute_force_over_documents(spark, tables):
    import re

    from quarry.operators.duplicates import lcs_length

    blocks = {}
    for r in spark.read.parquet(f"{tables}/documents.parquet").collect():
        tokens = tuple(re.split(r"\s+", r.text.strip(" ").lower()))
        blocks[tokens] = min(r.doc_id, blocks.get(tokens, r.doc_id))
    rows = sorted((i, t) for t, i in blocks.items())
    pairs = [(i, j, a, b) for k, (i, a) in enumerate(rows) for j, b in rows[k + 1 :] if 2 * min(len(a), len(b)) >= 0.79 * (len(a) + len(b))]
    want = {(i, j, round(score, 6)) for i, j, a, b in pairs if (score := 2 * lcs_length(a, b) / (len(a) + len(b))) >= 0.8}
    found = QUERIES["dup_similar"](spark, tables).collect()
    assert want and len(found) == len(want) and {(r.a, r.b, r.score) for r in found} == want


def test_dup_similar_shuffles_less_than_its_texts(spark, tables):
    def written():
        return sum(e.totalShuffleWrite() for e in [spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0)])

    before, texts = written(), sum(len((r.text or "").encode()) for r in spark.read.parquet(f"{tables}/documents.parquet").collect())
    assert QUERIES["dup_similar"](spark, tables).count() > 0
    assert written() - before < texts


def test_dup_similar_sends_no_texts_for_a_few_pairs_in_common(spark, tmp_path):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(5, 9))) for _ in range(100)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(400)]
    rows = list(enumerate([*texts, texts[7] + " again"]))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def written():
        return sum(e.totalShuffleWrite() for e in [spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0)])

    before = written()
    assert [(r.a, r.b) for r in QUERIES["dup_similar"](spark, str(tmp_path)).collect()] == [(7, 400)]
    assert written() - before < sum(map(len, texts))


def test_dup_similar_and_its_classes_lose_no_link_of_any_document(spark, tables):
    import re

    from quarry.operators.duplicates import lcs_length

    docs = [(r.doc_id, re.split(r"\s+", r.text.strip(" ").lower())) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    pairs = [(i, j, a, b) for k, (i, a) in enumerate(docs) for j, b in docs[k + 1 :] if 2 * min(len(a), len(b)) >= 0.79 * (len(a) + len(b))]
    want = {(min(i, j), max(i, j), round(score, 6)) for i, j, a, b in pairs if (score := 2 * lcs_length(a, b) / (len(a) + len(b))) >= 0.8}
    rows = QUERIES["dup_similar_classes"](spark, tables).collect()
    members = {c: [r.doc_id for r in rows if r.class_id == c] for c in {r.class_id for r in rows}}
    assert len(rows) == len(docs) > len(members)
    links = [(i, j, r.score) for r in QUERIES["dup_similar"](spark, tables).collect() for i in members[r.a] for j in members[r.b]]
    links += [(i, j, 1.0) for m in members.values() for i in m for j in m if i < j]
    assert len(links) == len(want) and {(min(i, j), max(i, j), s) for i, j, s in links} == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, tables):
    plan = QUERIES["theta_filter_join"](spark, tables)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<p_name:string>" in plan
    plan = QUERIES["regex_name_filter"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan


def test_no_python_in_relational_queries(spark, tables):
    for name in ("line_stats", "dup_line_blocks", "topk_per_group", "token_normalise", "fuzzy_match"):
        plan = QUERIES[name](spark, tables)._jdf.queryExecution().toString()
        assert "Python" not in plan and "InArrow" not in plan, name
