"""Numbers of links against SQL, and of a group of different near copies."""

import os

import duckdb

from canopygrid.llm import oracle, shingle_join

#: The links of the registered SQL, counted for each document.
LINKS = oracle.COMPONENTS[: oracle.COMPONENTS.index("reach AS")].rstrip().rstrip(",") + " SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a"


def found(df):
    return {r["doc_id"]: r["n_links"] for r in shingle_join.join(df).collect()}


def test_links_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[: 20 * k] + ["x"] + base[20 * k + 1 :]) for k in range(1, 7)]
    df = spark.createDataFrame([*enumerate(texts), (6, texts[0]), (7, "quite another text of some words"), (8, None), (9, "")], "doc_id long, text string")
    assert found(df) == {**dict.fromkeys(range(7), 6), 7: 0, 8: 0, 9: 0}


def test_links_equal_sql(spark, sf_dir):
    path = os.path.join(sf_dir, "documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
        want = dict(db.execute(LINKS).fetchall())
    assert want and {k: n for k, n in found(spark.read.parquet(path)).items() if n} == want
