"""Cached results, typed values, accuracy reports and the text report of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schemas as sc
from ..functions import text as tx
from ..plans import fixtures as fx
from . import classify, summary
from . import tables as tb
from . import text_queries as tq

# The words of the reports.
RATINGS = ((90, "XUẤT SẮC (Chữ rất rõ ràng)"), (75, "TỐT (Đọc chính xác hầu hết)"), (55, "TRUNG BÌNH (Có một số nét chữ bị mờ)"))
LOWEST = "THẤP (Ảnh bị mờ, nhiễu hoặc mất nét)"
EVALUATION = "  ĐÁNH GIÁ ĐỘ CHÍNH XÁC OCR"
CONFIDENCE = ("🔹 Độ tin cậy OCR trung bình (Model Confidence): ", "🔹 Tỷ lệ dòng độ tin cậy cao (≥ 80%):         ", "🔹 Đánh giá chất lượng đọc:                  ")
TRUTH = "📊 ĐỐI CHIẾU VĂN BẢN CHUẨN (GROUND TRUTH):"
TRUTH_LINES = {
    "char_accuracy": "  - Độ chính xác ký tự (Character Accuracy):  ",
    "word_accuracy": "  - Độ chính xác từ (Word Accuracy):          ",
    "cer_percent": "  - Tỷ lệ lỗi ký tự (CER):                     ",
    "wer_percent": "  - Tỷ lệ lỗi từ (WER):                        ",
}
RESULT, KIND, TYPE, SOURCE, METHOD = "=== KẾT QUẢ TRÍCH XUẤT TÀI LIỆU: ", "Danh mục: ", "Loại tài liệu (Document Type): ", "Định dạng nguồn (Source Type): ", "Phương pháp trích xuất: "
TEXT_PART, TABLE_PART = "--- NỘI DUNG VĂN BẢN ĐỌC ĐƯỢC ---", "--- CẤU TRÚC BẢNG TRÍCH XUẤT ---"


def reuse_cached(new: DataFrame, docs: DataFrame, schema: str = sc.DOC_RESULT) -> DataFrame:
    """New files (seq, user_id, file_hash, file_path, file_name) that a stored document answers, with its result.

    The latest completed document of the user with that hash counts, if its JSON is valid. The
    result, a DOC_RESULT unless another schema is given, takes hash, path, name and category of the new file.
    """
    kept = docs.where((F.col("status") == "completed") & F.col("file_hash").isNotNull())
    last = kept.groupBy("user_id", "file_hash").agg(F.max_by(F.struct("id", "ocr_data_json", F.col("category").alias("stored")), "id").alias("hit"))
    hits = new.join(last, ["user_id", "file_hash"]).where(F.try_parse_json("hit.ocr_data_json").isNotNull())
    result = F.from_json("hit.ocr_data_json", schema)
    over = {"file_hash": F.col("file_hash"), "file_path": F.col("file_path"), "original_filename": F.col("file_name"), "category": F.coalesce(F.nullif("hit.stored", F.lit("")), F.lit("khac"))}
    for name, value in over.items():
        result = result.withField(name, value)
    return hits.select("seq", F.col("hit.id").alias("cached_id"), result.alias("result"))


def evaluation(truths: DataFrame, lines: DataFrame) -> DataFrame:
    """Metrics of each reading (item_id, truth, predicted): confidence of its lines (item_id, prob) and, where there is a truth, accuracy.

    Percentages have two decimals. Without lines, or with an empty truth, the metrics are null.
    """
    percent = lambda x: F.bround(x * 100, 2)
    sure = lines.groupBy("item_id").agg(percent(F.avg("prob")).alias("avg_confidence"), percent(F.avg((F.col("prob") >= 0.8).cast("double"))).alias("high_confidence_ratio"))
    known = F.length("truth") > 0
    rates = tq.accuracy(truths).select("item_id", *[F.when(known, v).alias(n) for n, v in {
        "cer_percent": percent(F.col("cer")), "wer_percent": percent(F.col("wer")),
        "char_accuracy": F.greatest(F.lit(0.0), percent(1 - F.col("cer"))), "word_accuracy": F.greatest(F.lit(0.0), percent(1 - F.col("wer"))),
    }.items()])
    return rates.join(sure, "item_id", "left")


def evaluation_report(metrics: DataFrame) -> DataFrame:
    """The report (item_id, report) of each row of metrics; the rating goes by confidence."""
    conf = F.col("avg_confidence")
    rating = F.lit(LOWEST)
    for least, words in reversed(RATINGS):
        rating = F.when(conf >= least, words).otherwise(rating)
    line = lambda words, c: F.concat(F.lit(words), F.col(c).cast("string"), F.lit("%"))
    none = F.array().cast("array<string>")
    first = F.when(conf.isNotNull(), F.array(line(CONFIDENCE[0], "avg_confidence"), line(CONFIDENCE[1], "high_confidence_ratio"), F.concat(F.lit(CONFIDENCE[2]), rating))).otherwise(none)
    second = F.when(F.col("char_accuracy").isNotNull(), F.array(F.lit("-" * 60), F.lit(TRUTH), *[line(w, c) for c, w in TRUTH_LINES.items()])).otherwise(none)
    rule = F.lit(summary.RULE)
    return metrics.select("item_id", F.array_join(F.concat(F.array(rule, F.lit(EVALUATION), rule), first, second, F.array(rule)), "\n").alias("report"))


def text_report(docs: DataFrame, rendered: DataFrame, tables: DataFrame, evaluations: DataFrame | None = None) -> DataFrame:
    """The text report (id, report): facts, rendered summary, text, tables and, where there is one, the evaluation.

    docs has id, name, category, source_type, method, text; rendered and evaluations have id
    and report; tables has id, page, markdown, with any number for a document.
    """
    own = tables.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("page", "markdown"))).alias("ts"))
    d = docs.join(rendered.select("id", F.col("report").alias("shown")), "id", "left").join(own, "id", "left")
    if evaluations is None:
        d = d.withColumn("judged", F.lit(None).cast("string"))
    else:
        d = d.join(evaluations.select("id", F.col("report").alias("judged")), "id", "left")
    said = lambda words, x: F.concat(F.lit(words), F.coalesce(x, F.lit("None")))
    head = (F.concat(F.lit(RESULT), "name", F.lit(" ===")), said(KIND, F.col("category")), said(TYPE, classify.document_type(F.col("category"))), said(SOURCE, F.col("source_type")), said(METHOD, F.col("method")))
    each = F.transform("ts", lambda t, i: F.concat(F.lit("\n[Bảng "), (i + 1).cast("string"), F.lit(" - Trang "), t["page"].cast("string"), F.lit("]\n"), t["markdown"], F.lit("\n")))
    shown = F.when(F.size("ts") > 0, F.concat(F.lit(TABLE_PART + "\n"), F.array_join(each, ""))).otherwise("")
    judged = F.when(F.col("judged") != "", F.concat(F.lit("\n"), "judged", F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("\n\n"), F.coalesce("shown", F.lit("")), F.lit(f"\n\n{TEXT_PART}\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    return d.select("id", F.concat(F.concat_ws("\n", *head), body, shown, judged).alias("report"))


_CODES = (*classify.DOCUMENT_TYPES, "other")


def _code(x: str = "doc_id") -> str:
    return f"CASE {x} % {len(_CODES) + 1} {' '.join(f'''WHEN {i} THEN '{c}' ''' for i, c in enumerate(_CODES))} END"


def _values(spark, sf_dir):
    d = fx.rows(spark, sf_dir, tq.amounts).select("event_id", tx.date_value(F.col("day")).alias("d"), tx.amount_value(F.col("amount")).alias("a"))
    return d.select("event_id", F.col("d.value").alias("date"), F.col("d.raw_value").alias("raw_date"), F.col("a.value").alias("amount"), F.col("a.source").alias("source"))


def _reused(spark, sf_dir):
    new = fx.rows(spark, sf_dir, fx.incoming).withColumn("file_path", F.concat(F.lit("/in/"), "file_name"))
    return reuse_cached(new, fx.rows(spark, sf_dir, fx.ocr_documents), "k long").select("seq", "cached_id", "result.*")


def _metrics(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") % 50).alias("item_id"), (F.col("l_quantity") / 50).alias("prob"))
    return evaluation(fx.rows(spark, sf_dir, tq.pairs), lines.where("item_id % 5 <> 1"))


def _blanked(spark, sf_dir):
    rows = fx.rows(spark, sf_dir, tb.table_rows)
    blank = {f"c{i}": F.when(F.col("n") % 3 == 0, F.lit(" " if i % 2 else None)).otherwise(F.col(f"c{i}")) for i in range(1, 8)}
    kept = tb.matrices(rows.withColumns(blank)).select("id", tb.without_empty_rows(F.col("matrix")).alias("m"))
    return kept.select("id", F.size("m").alias("n_rows"), F.array_join(F.transform("m", lambda r: F.get(r, F.lit(0))), ";").alias("first_cells"))


def _report(spark, sf_dir):
    facts = (F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.lit("hoa_don").alias("category"), F.lit("plain_text").alias("source_type"), F.lit("direct_read").alias("method"))
    texts = fx.rows(spark, sf_dir, fx.invoice_texts)
    tables = tb.markdown(tb.matrices(fx.rows(spark, sf_dir, tb.table_rows))).select("id", F.lit(1).alias("page"), "markdown")
    return text_report(texts.select("id", *facts, "text"), summary.render(summary.invoice(texts), "invoice"), tables)


QUERIES = {
    "normalized_values": _values,
    "document_types": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", classify.document_type(F.expr(_code())).alias("document_type")),
    "reuse_cached": _reused,
    "drop_empty_rows": _blanked,
    "evaluation_metrics": _metrics,
    "evaluation_report": lambda spark, sf_dir: evaluation_report(_metrics(spark, sf_dir)),
    "text_report": _report,
}

_NL = " || chr(10) || "
_TYPES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in classify.DOCUMENT_TYPES.items())
_EVAL = f"""{tq._DP}, s AS (SELECT l_orderkey % 50 AS item_id, round_even(avg(l_quantity / 50) * 100, 2) AS avg_confidence, round_even(count(*) FILTER (WHERE l_quantity / 50 >= 0.8) / count(*) * 100, 2) AS high_confidence_ratio FROM lineitem WHERE (l_orderkey % 50) % 5 <> 1 GROUP BY 1),
m AS (SELECT r.item_id, avg_confidence, high_confidence_ratio, CASE WHEN nt > 0 THEN round_even(cer * 100, 2) END AS cer_percent, CASE WHEN nt > 0 THEN round_even(wer * 100, 2) END AS wer_percent,
  CASE WHEN nt > 0 THEN greatest(0.0, round_even((1 - cer) * 100, 2)) END AS char_accuracy, CASE WHEN nt > 0 THEN greatest(0.0, round_even((1 - wer) * 100, 2)) END AS word_accuracy FROM r LEFT JOIN s ON r.item_id = s.item_id)"""
_RATED = f"CASE {' '.join(f'''WHEN avg_confidence >= {n} THEN '{w}' ''' for n, w in RATINGS)} ELSE '{LOWEST}' END"
_SHOWN = f"'{CONFIDENCE[0]}' || avg_confidence || '%'{_NL}'{CONFIDENCE[1]}' || high_confidence_ratio || '%'{_NL}'{CONFIDENCE[2]}' || {_RATED}"
_COMPARED = f"'{'-' * 60}'{_NL}'{TRUTH}'{_NL}" + _NL.join(f"'{w}' || {c} || '%'" for c, w in TRUTH_LINES.items())

ORACLES = {
    "normalized_values": f"SELECT event_id, nullif({tq.duck_clean_date('day')}, '') AS date, CASE WHEN day <> '' THEN trim(day) END AS raw_date, {tq.duck_amount('amount')} AS amount, CASE WHEN {tq.duck_amount('amount')} IS NOT NULL THEN 'ocr' END AS source FROM {tq.AM}",
    "document_types": f"SELECT doc_id, CASE {_code()} {_TYPES} ELSE 'unknown' END AS document_type FROM documents",
    "reuse_cached": f"""WITH k AS (SELECT user_id, file_hash, max(id) AS cached_id, arg_max(ocr_data_json, id) AS js, arg_max(category, id) AS category FROM {fx.duck(fx.ocr_documents)} WHERE status = 'completed' AND file_hash IS NOT NULL GROUP BY ALL)
SELECT seq, cached_id, CAST(js->>'k' AS BIGINT) AS k, n.file_hash, '/in/' || file_name AS file_path, file_name AS original_filename, k.category FROM {fx.duck(fx.incoming)} n JOIN k ON n.user_id = k.user_id AND n.file_hash = k.file_hash WHERE json_valid(js)""",
    "drop_empty_rows": f"SELECT id, CAST(1 + count(*) FILTER (WHERE n % 3 <> 0) AS INTEGER) AS n_rows, concat('STT', ';' || string_agg(c1, ';' ORDER BY n) FILTER (WHERE n % 3 <> 0)) AS first_cells FROM {fx.duck(tb.table_rows)} GROUP BY id",
    "evaluation_metrics": f"{_EVAL} SELECT * FROM m",
    "evaluation_report": f"{_EVAL} SELECT item_id, concat('{summary.RULE}'{_NL}'{EVALUATION}'{_NL}'{summary.RULE}' || chr(10), CASE WHEN avg_confidence IS NOT NULL THEN {_SHOWN} || chr(10) END, CASE WHEN char_accuracy IS NOT NULL THEN {_COMPARED} || chr(10) END, '{summary.RULE}') AS report FROM m",
    "text_report": f"""WITH s AS ({summary.ORACLES['render_invoice']}), t AS ({tb.ORACLES['markdown_table']})
SELECT x.id, concat('{RESULT}' || x.id || '.txt ==='{_NL}'{KIND}hoa_don'{_NL}'{TYPE}invoice'{_NL}'{SOURCE}plain_text'{_NL}'{METHOD}direct_read' || chr(10) || chr(10) || s.report || chr(10) || chr(10) || '{TEXT_PART}'{_NL}text || chr(10) || chr(10),
  '{TABLE_PART}' || chr(10) || chr(10) || '[Bảng 1 - Trang 1]' || chr(10) || t.value || chr(10)) AS report FROM {fx.duck(fx.invoice_texts)} x JOIN s ON s.id = x.id LEFT JOIN t ON t.id = x.id""",
}
