"""Derived inputs, written once as SQL that Spark and DuckDB both run.

Each fixture is a SELECT over the raw tables. The few functions that the two engines name
differently come from a dialect.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are worked on for long; the others are looked up.
LARGE = ("orders", "documents", "events", "lineitem")
#: What large tables are grouped or joined by.
KEYS = {"orders": "o_custkey", "lineitem": "l_orderkey"}
#: Bytes of a large table's files for one task: rows of a kilobyte of text are made of some twenty bytes each.
PART = 2 << 20
#: Where a fixture names a raw table.
READS = re.compile(r"\b(FROM|JOIN) (customer|orders|lineitem|events|documents|benchmark|conversations|nation)\b")


@dataclass(frozen=True)
class Dialect:
    sha: str
    minutes: str
    whole: str  # integer division by a constant is floor(x / n) in both; this casts it
    upto: str  # one row for each whole number from 0 on


SPARK = Dialect("sha2({0}, 256)", "timestampadd(MINUTE, {0}, timestamp_ntz'2024-01-01 00:00:00')", "CAST(floor({0}) AS bigint)", "explode(sequence(0, {0}))")
DUCK = Dialect("sha256({0})", "(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({0} AS bigint)))", "CAST(floor({0}) AS bigint)", "unnest(range(0, {0} + 1))")


def each(d: Dialect, made: list[dict[str, str | None]]) -> str:
    """One row for each struct of named expressions; where its condition `where` doesn't hold, a null."""
    out = []
    for m in made:
        fields = {k: v for k, v in m.items() if k != "where"}
        one = f"named_struct({', '.join(f'{k!r}, {v}' for k, v in fields.items())})" if d is SPARK else f"{{{', '.join(f'{k!r}: {v}' for k, v in fields.items())}}}"
        out.append(f"CASE WHEN {m['where']} THEN {one} ELSE NULL END" if m.get("where") else one)
    return f"explode(array({', '.join(out)}))" if d is SPARK else f"unnest([{', '.join(out)}])"


def ocr_documents(d: Dialect) -> str:
    return f"""SELECT doc_id AS id, 'user_' || CAST(doc_id % 7 AS string) AS user_id, source || '_' || lang || '.txt' AS file_name,
  '/data/' || source || '/' || CAST(doc_id AS string) || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' WHEN 2 THEN '.xlsx' ELSE '.zip' END AS file_path,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars END AS file_size,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE '.txt' END AS file_type, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE {d.sha.format('text')} END AS file_hash,
  CASE WHEN doc_id % 13 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE lang WHEN 'en' THEN 'hop_dong' WHEN 'de' THEN 'hoa_don' WHEN 'fr' THEN 'chung_tu' ELSE 'khac' END AS category,
  text AS extracted_text, CASE WHEN doc_id % 50 = 0 THEN '{{bad' ELSE '{{"k": ' || CAST(doc_id % 100 AS string) || '}}' END AS ocr_data_json,
  {d.minutes.format('doc_id')} AS created_at FROM documents"""


def incoming(d: Dialect) -> str:
    return f"""SELECT doc_id AS seq, 'user_' || CAST(doc_id % 7 AS string) AS user_id,
  CASE WHEN doc_id % 5 = 2 THEN 'new_' || CAST(doc_id AS string) || '.txt' ELSE source || '_' || lang || '.txt' END AS file_name,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars END AS file_size,
  CASE WHEN doc_id % 5 = 0 THEN {d.sha.format('text')} WHEN doc_id % 5 = 1 THEN NULL ELSE {d.sha.format("text || 'x'")} END AS file_hash,
  'hop_dong' AS category, '/in/' || CAST(doc_id AS string) AS file_path, '.txt' AS file_type, text || '!' AS extracted_text, '{{"n": ' || CAST(doc_id AS string) || '}}' AS ocr_data_json,
  'failed' AS status, {d.minutes.format('doc_id + 90000')} AS created_at FROM documents"""


def messages(d: Dialect) -> str:
    return """SELECT conv_id * 1000 + turn AS id, 'session_' || CAST(conv_id AS string) AS session_id,
  CASE WHEN turn % 4 = 3 THEN 'default_user' ELSE 'user_' || CAST(conv_id % 7 AS string) END AS user_id, role, text AS content,
  CASE WHEN role = 'user' AND turn % 3 = 0 THEN '[HỆ THỐNG]: ' || text ELSE NULL END AS display_content,
  CASE WHEN turn % 2 = 0 THEN '{"doc": ' || CAST(conv_id AS string) || '}' ELSE NULL END AS doc_result_json FROM conversations"""


def sessions(d: Dialect) -> str:
    made = lambda x: d.minutes.format(x)
    return f"""SELECT 'session_' || CAST(conv_id AS string) AS session_id, 'user_' || CAST(conv_id % 7 AS string) AS user_id, 'New Chat' AS title,
  {made('conv_id')} AS created_at, {made('conv_id % 50')} AS updated_at FROM (SELECT DISTINCT conv_id FROM conversations) c
  UNION ALL SELECT 'empty_' || CAST(n_nationkey AS string), 'user_' || CAST(n_nationkey % 7 AS string), 'New Chat', {made('n_nationkey')}, {made('n_nationkey')} FROM nation"""


def _dotted(x: str) -> str:
    """A whole number under a million with a dot before its last three digits."""
    return f"CASE WHEN {x} >= 1000 THEN CAST(CAST(floor({x} / 1000) AS bigint) AS string) || '.' || lpad(CAST({x} % 1000 AS string), 3, '0') ELSE CAST({x} AS string) END"


_ORDER = "SELECT o_orderkey, o_custkey, c_name, c_nationkey, c_acctbal, CAST(floor(o_totalprice) AS bigint) AS total, lpad(CAST(day(o_orderdate) AS string), 2, '0') AS dd, lpad(CAST(month(o_orderdate) AS string), 2, '0') AS mm, CAST(year(o_orderdate) AS string) AS yy FROM orders JOIN customer ON o_custkey = c_custkey"


def invoice_texts(d: Dialect) -> str:
    return f"""SELECT o_orderkey AS id, concat_ws(chr(10), 'HÓA ĐƠN GIÁ TRỊ GIA TĂNG', 'Ký hiệu: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'AA/23E' ELSE 'BB/24T' END, 'Số: ' || CAST(o_orderkey AS string),
  CASE WHEN o_orderkey % 3 = 0 THEN 'Ngày ' || dd || ' tháng ' || mm || ' năm ' || yy ELSE 'Ngày ' || dd || '/' || mm || '/' || yy END,
  'Đơn vị bán hàng: Công ty ' || CAST(c_nationkey AS string) || ' -', 'Mã số thuế: ' || lpad(CAST(o_orderkey AS string), 10, '1'), 'Địa chỉ: Số nhà ' || CAST(o_custkey AS string), 'Số tài khoản: ' || lpad(CAST(o_custkey AS string), 12, '9'),
  'Họ tên người mua hàng: ' || c_name, 'Tên đơn vị: ' || c_name || ' TNHH', 'MST: ' || lpad(CAST(o_custkey AS string), 10, '2') || '-001',
  'CỘNG TIỀN HÀNG: ' || {_dotted('total')} , 'Thuế suất GTGT: 10%', 'Tiền thuế GTGT: ' || {_dotted('o_custkey')}, 'TỔNG TIỀN THANH TOÁN: ' || {_dotted('total')},
  CASE WHEN o_orderkey % 2 = 0 THEN 'Hình thức: TM/CK' ELSE 'Hình thức: tiền mặt' END, 'Số tiền viết bằng chữ: một trăm đồng.') AS text FROM ({_ORDER}) o"""


def contract_texts(d: Dialect) -> str:
    return f"""SELECT o_orderkey AS id, concat_ws(chr(10), 'CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM', CASE WHEN o_orderkey % 4 = 0 THEN 'THỎA THUẬN' ELSE 'HỢP ĐỒNG DỊCH VỤ' END,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Hợp đồng số: HD-' || CAST(o_orderkey AS string) ELSE lpad(CAST(o_orderkey AS string), 6, '1') || '/' || yy || '-AB' END, 'Ngày ' || dd || ' tháng ' || mm || ' năm ' || yy,
  'Bên A: ' || c_name, 'Đại diện: Ông Nam Chức vụ: Giám đốc', 'Mã số thuế: ' || lpad(CAST(o_custkey AS string), 10, '3'),
  'Bên B: Nhà cung cấp ' || CAST(c_nationkey AS string), 'MST: ' || lpad(CAST(o_orderkey AS string), 10, '4'), 'Tài khoản ngân hàng: ' || lpad(CAST(o_custkey AS string), 9, '7') || ' - ACB', 'ĐIỀU 1: Nội dung', 'Điều 2. Giá',
  'Tổng cộng thanh toán (VND): ' || {_dotted('total')}, 'Thanh toán bằng chuyển khoản') AS text FROM ({_ORDER}) o"""


def voucher_texts(d: Dialect) -> str:
    return f"""SELECT o_orderkey AS id, concat_ws(chr(10), CASE o_orderkey % 5 WHEN 0 THEN 'BIÊN BẢN BÀN GIAO' WHEN 1 THEN 'PHIẾU XUẤT KHO' WHEN 2 THEN 'BIÊN BẢN THANH LÝ' WHEN 3 THEN 'Phiếu thu' ELSE 'CHỨNG TỪ' END,
  'No. PX-' || CAST(o_orderkey AS string), CASE WHEN o_orderkey % 2 = 0 THEN 'Ngày ' || dd || ' tháng ' || mm || ' năm ' || yy ELSE 'Lập: ' || dd || '-' || mm || '-' || yy END,
  '(Căn cứ theo lệnh ' || CAST(o_custkey AS string) || ')', 'Kho xuất: Kho ' || CAST(c_nationkey AS string), 'BÊN GIAO: ' || c_name, 'BÊN NHẬN: Chi nhánh ' || CAST(c_nationkey AS string),
  'Bảo hành 12 tháng', 'Kết luận: đạt', 'tổng số tiền ' || {_dotted('total')} || ' VNĐ', 'Số tiền: ' || {_dotted('total')}) AS text FROM ({_ORDER}) o"""


def transfer_texts(d: Dialect) -> str:
    return f"""SELECT o_orderkey AS id, concat_ws(chr(10), CASE o_orderkey % 3 WHEN 0 THEN 'Giao dịch thành công' WHEN 1 THEN 'Giao dịch thất bại' ELSE 'Đang chờ' END,
  CASE o_orderkey % 3 WHEN 0 THEN {_dotted('total')} || ' VND' WHEN 1 THEN {_dotted('total')} ELSE 'Số tiền: ' || {_dotted('total')} END, 'Mã giao dịch: FT' || lpad(CAST(o_orderkey AS string), 8, '0'),
  CASE WHEN o_orderkey % 2 = 0 THEN '10:15:30 - ' ELSE 'Lúc ' END || dd || '/' || mm || '/' || yy, CASE WHEN o_orderkey % 4 = 0 THEN 'NGUYEN VAN AN' ELSE 'Người nhận: ' || c_name END,
  'Tài khoản nhận: ' || lpad(CAST(o_custkey AS string), 10, '5'), CASE WHEN o_orderkey % 5 = 0 THEN 'Ngân hàng TMCP ACB' ELSE 'Ngân hàng Techcombank, VIB' END, 'Nội dung: thanh toan ' || CAST(o_orderkey AS string)) AS text FROM ({_ORDER}) o"""


def spread(table: DataFrame, key: str | None = None, part: int = PART) -> DataFrame:
    """A table dealt to tasks of about `part` bytes of its files, at least one a core: little is read, but much is made of it.

    By a key, rows of one key meet, so that what groups or joins by it needs no further
    shuffle and has as many tasks; their number grows with the table.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(cores, -(-size // part))
    if key:
        return table.repartition(n, key)
    return table.repartition(n) if table.rdd.getNumPartitions() < n else table


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a fixture in Spark, over views of the tables that it reads."""
    for t in {m[2] for m in READS.finditer(sql)}:
        table = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        (spread(table, KEYS.get(t)) if t in LARGE else table).createOrReplaceTempView(f"doclathe_{t}")
    return spark.sql(READS.sub(r"\1 doclathe_\2", sql))


def rows(spark: SparkSession, sf_dir: str, fixture) -> DataFrame:
    return spark_view(spark, sf_dir, fixture(SPARK))


def duck(fixture) -> str:
    return f"({fixture(DUCK)})"
