"""Every registered query against its SQL on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sievework.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    if isinstance(v, dict):
        return tuple(map(cell, v.values()))
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def agree(spark, db, name, queries, oracles):
    df = queries[name](spark, SF)
    got = canonical(df.columns, df.collect())
    if name in oracles:
        res = db.execute(oracles[name])
        assert got == canonical([c[0] for c in res.description], res.fetchall())
    else:
        assert got[1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    agree(spark, db, name, catalog.QUERIES, catalog.ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_formatted_cells_keeps_long_documents(spark, tmp_path):
    rows = [(1, "a", 1), (2, "b" * 200_000, 200_000), (3, "c" * 3_000_000, 3_000_000)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.size, len(r.short)) for r in catalog.QUERIES["formatted_cells"](spark, str(tmp_path)).collect()}
    assert got == {1: ("1 B", 1), 2: ("195.3 KB", 60), 3: ("2.9 MB", 60)}


def agree_on(spark, tmp_path, name, table, rows, schema):
    """``name`` gives what its SQL gives over ``rows``; its result."""
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    if os.path.isdir(f"{tmp_path}/benchmark.parquet"):
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    got = canonical(df.columns, df.collect())
    res = con.execute(catalog.ORACLES[name])
    assert got == canonical([c[0] for c in res.description], res.fetchall())
    return got[1]


def test_regex_match_finds_its_literal_inside_words(spark, tmp_path):
    """the literal of a pattern is anywhere in the text; places count code points, also after those outside of Java's characters."""
    pages = ["lengthen these ththx", "Then the onon", "then, the thth", "\U0001f600\U0001f600 then\nathen thex \U0001f600 onon &amp; ?page=1", "é\u20ac ABC &lt;", "", None]
    got = agree_on(spark, tmp_path, "regex_match", "pages", list(enumerate(pages)), "page_id long, html string")
    assert len(got) == 7


def test_large_pack_match_on_odd_texts(spark, tmp_path):
    """words inside words, several rules at one place, places that fail before one that fits, long words, null and empty texts."""
    spark.createDataFrame([("theme them Other, others extraordinarily sand",)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["othersand and them  me", "them. them, them x", "THEM  x them X", "\U0001f600 é them é them a", "extraordinarilythem\nthem b", "other_s sand1 sand  b", "sands" * 3000 + " z", "them", "", None]
    got = agree_on(spark, tmp_path, "large_pack_match", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert len(got) == 6


def test_identifier_entropy_measures_each_text_once(spark, tmp_path):
    """a text is cut into names in one place of the plan; odd texts as in SQL."""
    texts = ["obfu_scated1name obfuscatedname bcdfghjklmn OOIlIlOOl", "verti\x0bcaltab form\x0cfeedfeed\x0dcarriage", "ünïcödelettersinside naïveletters", "short words", "aaaaaaaaa " * 3, "", None]
    got = agree_on(spark, tmp_path, "identifier_entropy", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert len(got) == 4
    plan = catalog.QUERIES["identifier_entropy"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text") == 1
