"""Users stay apart, and snapshots behave when they are made twice."""

from __future__ import annotations

from doclathe.operators import extract, store, tables
from doclathe.plans import fixtures as fx
from conftest import SF
from pyspark.sql import functions as F


def test_users_stay_apart(spark):
    s = spark.createDataFrame([("s1", "alice", "A"), ("s2", "bob", "B")], "session_id string, user_id string, title string").selectExpr("*", "timestamp_ntz'2024-01-01' AS created_at", "timestamp_ntz'2024-01-02' AS updated_at")
    m = spark.createDataFrame([(1, "s1", "alice", "hi", None), (2, "s1", "alice", "yo", "shown"), (3, "s2", "bob", "x", None)], "id int, session_id string, user_id string, content string, display_content string")
    got = store.session_listing(s, m, "alice").collect()
    assert [(r.session_id, r.message_count, r.last_message) for r in got] == [("s1", 2, "shown")]


def test_dedup_is_idempotent(spark):
    docs = fx.rows(spark, SF, fx.ocr_documents)
    once = store.dedup_keep_latest(docs)
    assert once.count() == store.dedup_keep_latest(once).count() < docs.count()


def test_plans_have_no_python(spark):
    docs = fx.rows(spark, SF, fx.invoice_texts)
    for df in (extract.invoice(docs), extract.contract(docs), store.latest_by_hash(fx.rows(spark, SF, fx.ocr_documents))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_listing_prunes_texts(spark):
    plan = store.list_documents(fx.rows(spark, SF, fx.ocr_documents), "user_2")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint" in plan


def test_clearing_keeps_messages_without_session(spark):
    m = spark.createDataFrame([(1, None, "a"), (2, "s4", None), (3, "s4", "a"), (4, "s5", "a")], "id int, session_id string, user_id string")
    assert sorted(r.id for r in store.clear_messages(m, "s4").collect()) == [1, 4]
    assert sorted(r.id for r in store.clear_messages(m, "s4", "a").collect()) == [1, 2, 4]


def test_dedup_leaves_nulls_alone(spark):
    rows = [(1, "u", None, "f", 5), (2, "u", None, "f", 5), (3, "u", "h", "g", None), (4, "u", "h", "x", None), (5, "v", "h", "g", 1), (6, None, "h", "g", 1), (7, None, "h", "g", 1)]
    df = spark.createDataFrame(rows, "id int, user_id string, file_hash string, file_name string, file_size long")
    assert sorted(r.id for r in store.dedup_keep_latest(df).collect()) == [2, 4, 5, 6, 7]


def test_the_first_fitting_capital_line_is_the_recipient(spark):
    cases = {"GIAO DICH THANH CONG\nNGUYEN VAN AN\nTRAN BINH": "NGUYEN VAN AN", "VND\nABC": None, "  LE  HOA  \nx": "LE  HOA", "Người nhận: Bình\nNGUYEN VAN AN": "Bình", "SO TIEN VND": None}
    df = spark.createDataFrame(list(enumerate(cases)), "id long, text string")
    assert [r.ho_ten for r in extract.transfer(df).orderBy("id").collect()] == list(cases.values())


def test_empty_rows_go(spark):
    df = spark.createDataFrame([([["a", ""], ["", " \n"], [None], [], ["", "b"]],)], "m array<array<string>>")
    assert df.select(tables.without_empty_rows(F.col("m")).alias("m")).first().m == [["a", ""], ["", "b"]]


def test_each_pattern_meets_a_text_once(spark):
    plan = extract.invoice(fx.rows(spark, SF, fx.invoice_texts))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Tổng cộng tiền thanh toán") == 1
