"""Every query with SQL against DuckDB on the smallest tables; every other one has rows and a stable schema."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
NAMES = [n for n in entry.registry.queries()]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(int(v) if isinstance(v, bool) else v)
        return f"{float(v):.9g}"

    return sorted(columns), sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    got = df.collect()
    assert entry.queries()[name](spark, FOLDER).schema == df.schema
    if name in entry.oracle_sql():
        found = sql.execute(entry.oracle_sql()[name])
        assert plain(got, df.columns) == plain(found.fetchall(), [d[0] for d in found.description])
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_words_of_a_document_are_not_shuffled(spark):
    """What groups words by document, or terms by page, has the exchange of the texts and no other (but where a Python step lies between)."""
    from vellum.operators import layout as Y
    from vellum.operators import search as S
    from vellum.plans import model as M

    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(Y.pages(M.words(spark, FOLDER))) == 1
    assert exchanges(S.index(M.page_text(spark, FOLDER))[0]) == 1
    assert all(exchanges(entry.queries()[n](spark, FOLDER)) == 1 for n in ("lighting", "hocr_words"))


def test_index_is_saved_without_shuffling_postings(spark, tmp_path):
    """Segments by page, each sorted by term: a frequent term is spread over all, and repeated pages keep all their places."""
    from vellum.operators import search as S

    rows = [(f"s{k}", 0, f"the word{k} the Éa") for k in range(40)] + [("s1", 0, "the"), ("s2", 1, None), ("s3", 1, " - ")]
    pages = spark.createDataFrame(rows, "scan_id string, page_index int, text string").repartition(4, "scan_id")
    S.save(pages, str(tmp_path))
    postings, lengths = S.load(spark, str(tmp_path))
    got = {(r.term, r.scan_id, r.page_index): (r.tf, r.positions) for r in postings.collect()}
    want = {(t, f"s{k}", 0): (n, p) for k in range(40) for t, n, p in (("the", 2, [0, 2]), (f"word{k}", 1, [1]), ("ea", 1, [3]))}
    assert got == want | {("the", "s1", 0): (3, [0, 0, 2])} and lengths.count() == len(rows)
    files = postings.groupBy(F.input_file_name().alias("f")).agg(F.collect_list("term").alias("terms")).collect()
    assert len(files) > 1 and all("the" in r.terms and r.terms == sorted(r.terms) for r in files)


def test_lengths_need_no_saved_index(spark, tmp_path, monkeypatch):
    """What reads every posting or length once saves no index first."""
    from vellum.operators import search as S

    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(S, "save", None)
    assert {(r.scan_id, r.length) for r in entry.queries()["search_lengths"](spark, str(tmp_path)).collect()} == {("1", 2), ("2", 1)}
    assert entry.queries()["search_index"](spark, str(tmp_path)).count() == 3


def test_words_are_cut_in_parts_of_bounded_size(spark, monkeypatch):
    """Texts are dealt into as many parts as their size asks for, however few Spark would make of them."""
    from vellum.plans import model as M

    monkeypatch.setattr(M, "CUT", 1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(M.tables, "size", lambda *_: n + 7)
    assert all(df.rdd.getNumPartitions() == n + 7 for df in (M.words(spark, FOLDER), M.page_text(spark, FOLDER)))


def test_word_lists_shuffle_no_words(spark):
    """A document is one row from its list on: neither lists nor words are shuffled."""
    plan = entry.queries()["word_lists"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_quads_are_not_shuffled(spark):
    """Quads are made of texts that are dealt by page, and stay there: the exchange of the texts is the only one."""
    plan = entry.queries()["recognised_pages"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "split_pages" in plan and plan.count("Exchange") == 1


def test_words_put_in_reading_order_are_not_shuffled(spark, sql, monkeypatch):
    """Texts dealt into more parts than Spark shuffles into, as larger tables are: ids of lines and words meet where the texts lie."""
    from vellum.plans import model as M

    n = int(spark.conf.get("spark.sql.shuffle.partitions")) + 7
    monkeypatch.setattr(M, "CUT", 1)
    monkeypatch.setattr(M.tables, "size", lambda *_: n)
    df = entry.queries()["words_in_reading_order"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 2
    found = sql.execute(entry.oracle_sql()["words_in_reading_order"])
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), [d[0] for d in found.description])
