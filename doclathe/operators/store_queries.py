"""Store queries over the fixtures, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import fixtures as fx
from . import store

D, I, M, S = fx.duck(fx.ocr_documents), fx.duck(fx.incoming), fx.duck(fx.messages), fx.duck(fx.sessions)
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _on(*fixtures):
    """A query whose function takes the named fixtures."""

    def wrap(f):
        return lambda spark, sf_dir: f(*[fx.rows(spark, sf_dir, x) for x in fixtures])

    return wrap


docs_, new_, messages_, sessions_ = fx.ocr_documents, fx.incoming, fx.messages, fx.sessions


def _asked(docs):
    user = F.concat(F.lit("user_"), (F.col("id") % 5).cast("string"))
    return docs.select(F.col("id").alias("ask_id"), user.alias("user_id"), F.when(F.col("id") % 3 == 0, F.col("id") + 10_000_000).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.col("file_name")).otherwise("none.txt").alias("name"))


def _calls(messages):
    return messages.where("role = 'user'").select(F.concat(F.col("session_id"), F.when(F.col("id") % 2 == 0, "").otherwise("_b")).alias("session_id"), "user_id", F.expr("timestampadd(MINUTE, id, timestamp_ntz'2024-02-01 00:00:00')").alias("at"))


def _gone(sessions):
    return sessions.where("user_id = 'user_3'").select("session_id", "user_id")


def _delete(sessions, messages):
    left, said = store.delete_sessions(sessions, messages, _gone(sessions))
    return left.select(F.lit("session").alias("kind"), "session_id", F.lit(None).cast("long").alias("id")).unionByName(said.select(F.lit("message").alias("kind"), "session_id", "id"))


def _identity(messages):
    return messages.select("id", store.resolve_identity(F.when(F.col("id") % 2 == 0, "").otherwise(F.col("user_id")), F.when(F.col("id") % 3 == 0, F.col("session_id")), F.lit("")).alias("identity"))


def _ensure(sessions, messages):
    out = store.ensure_sessions(sessions, _calls(messages))
    return out.select("session_id", "user_id", "title", store.stamp("created_at").alias("created_at"), store.stamp("updated_at").alias("updated_at"))


def _said(sessions, messages):
    new = _NEW_MESSAGES(messages).withColumns({"session_id": F.concat("session_id", F.when(F.col("seq") % 2 == 0, "").otherwise("_n")), "at": F.expr("timestampadd(MINUTE, seq, timestamp_ntz'2024-02-01 00:00:00')")})
    out, _ = store.say(sessions, messages, new)
    return out.select("session_id", "user_id", "title", store.stamp("created_at").alias("created_at"), store.stamp("updated_at").alias("updated_at"))


_NEW_MESSAGES = lambda m: m.where("role = 'user'").select(F.col("id").alias("seq"), "session_id", "user_id", F.lit("assistant").alias("role"), F.concat(F.lit("re: "), "content").alias("content"), F.lit("{}").alias("doc_result_json"))

QUERIES = {
    "latest_by_hash": _on(docs_)(store.latest_by_hash),
    "latest_by_name": _on(docs_)(store.latest_by_name),
    "doc_by_id": _on(docs_)(lambda d: store.doc_by_id(d, 17, "user_3").select("id", "file_name", "status")),
    "list_documents": _on(docs_)(lambda d: store.list_documents(d, "user_2", "hop_dong", 100)),
    "file_list_view": _on(docs_)(lambda d: store.file_list_view(d, limit=500)),
    "resolve_document": _on(docs_)(lambda d: store.resolve_documents(_asked(d), d)),
    "chat_history": _on(messages_)(lambda m: store.chat_history(m, "session_5", "user_5")),
    "session_listing": _on(sessions_, messages_)(store.session_listing),
    "last_doc_in_session": _on(messages_)(store.last_doc_in_session),
    "resolve_identity": _on(messages_)(_identity),
    "upsert_documents": _on(docs_, new_)(lambda d, n: store.upsert_documents(d, n).withColumn("created_at", store.stamp("created_at"))),
    "dedup_keep_latest": _on(docs_)(lambda d: store.dedup_keep_latest(d).select("id", "user_id", "file_name")),
    "ensure_session": _on(sessions_, messages_)(_ensure),
    "append_messages": _on(messages_)(lambda m: store.append_messages(m, _NEW_MESSAGES(m))),
    "say_sessions": _on(sessions_, messages_)(_said),
    "rename_session": _on(sessions_)(lambda s: store.rename_session(s, "session_3", "Hợp đồng", "user_3").select("session_id", "title")),
    "auto_title": _on(messages_)(store.auto_titles),
    "delete_session": _on(sessions_, messages_)(_delete),
    "clear_messages": _on(messages_)(lambda m: store.clear_messages(m, "session_4").select("id", "session_id")),
    "content_hash": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash")),
    "cache_partition": _on(new_, docs_)(store.cache_partition),
}

_CALLS = f"(SELECT session_id || CASE WHEN id % 2 = 0 THEN '' ELSE '_b' END AS session_id, user_id, TIMESTAMP '2024-02-01 00:00:00' + to_minutes(id) AS seen FROM {M} WHERE role = 'user')"
_FIELDS = "user_id, file_name, file_path, file_size, file_type, file_hash, status, category, extracted_text, ocr_data_json"
_ALL = "session_id, user_id, role, content, display_content, doc_result_json"

ORACLES = {
    "latest_by_hash": f"SELECT user_id, file_hash, max(id) AS id, arg_max(file_name, id) AS file_name, arg_max(ocr_data_json, id) AS ocr_data_json, json_valid(arg_max(ocr_data_json, id)) AS is_json FROM {D} WHERE status = 'completed' AND file_hash <> '' GROUP BY user_id, file_hash",
    "latest_by_name": f"SELECT user_id, file_name, max(id) AS id, arg_max(status, id) AS status FROM {D} GROUP BY ALL",
    "doc_by_id": f"SELECT id, file_name, status FROM {D} WHERE id = 17 AND user_id = 'user_3' LIMIT 1",
    "list_documents": f"SELECT id, user_id, file_name, file_size, file_type, category, status, {TS.format('created_at')} AS created_at FROM {D} WHERE user_id = 'user_2' AND category = 'hop_dong' ORDER BY id DESC LIMIT 100",
    "file_list_view": f"SELECT id, coalesce(nullif(file_name, ''), 'document') AS name, CAST(coalesce(nullif(file_size, 0), 1024) AS BIGINT) AS size, coalesce(nullif(file_type, ''), nullif(lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)), ''), '.pdf') AS type, category, {TS.format('created_at')} AS updated_at FROM {D} ORDER BY id DESC LIMIT 500",
    "resolve_document": f"""WITH d AS {D}, a AS (SELECT id AS ask_id, 'user_' || (id % 5) AS user_id, CASE WHEN id % 3 = 0 THEN id + 10000000 ELSE id END AS doc_id, CASE WHEN id % 2 = 0 THEN file_name ELSE 'none.txt' END AS name FROM d),
r AS (SELECT ask_id, (SELECT max(id) FROM d WHERE d.id = a.doc_id AND d.user_id = a.user_id) AS i1, (SELECT max(id) FROM d WHERE d.id = a.doc_id) AS i2, (SELECT max(id) FROM d WHERE d.file_name = a.name AND d.user_id = a.user_id) AS i3, (SELECT max(id) FROM d WHERE d.file_name = a.name) AS i4 FROM a)
SELECT ask_id, coalesce(i1, i2, i3, i4) AS id, CASE WHEN i1 IS NOT NULL THEN 'own id' WHEN i2 IS NOT NULL THEN 'any id' WHEN i3 IS NOT NULL THEN 'own name' WHEN i4 IS NOT NULL THEN 'any name' END AS step FROM r""",
    "chat_history": f"SELECT id, role, content, nullif(display_content, '') AS display_content, nullif(doc_result_json, '') AS doc_result_json FROM {M} WHERE session_id = 'session_5' AND (user_id = 'user_5' OR user_id = 'default_user') ORDER BY id",
    "session_listing": f"SELECT s.session_id, s.user_id, s.title, {TS.format('s.created_at')} AS created_at, {TS.format('s.updated_at')} AS updated_at, count(m.id) AS message_count, arg_max(coalesce(m.display_content, m.content), m.id) AS last_message FROM {S} s LEFT JOIN {M} m ON m.session_id = s.session_id GROUP BY ALL",
    "last_doc_in_session": f"SELECT session_id, max(id) AS id, arg_max(doc_result_json, id) AS doc_result_json FROM {M} WHERE doc_result_json <> '' GROUP BY session_id",
    "resolve_identity": f"SELECT id, coalesce(nullif(CASE WHEN id % 2 = 0 THEN '' ELSE user_id END, ''), CASE WHEN id % 3 = 0 THEN session_id END, 'default_user') AS identity FROM {M}",
    "upsert_documents": f"""WITH d AS {D}, n AS {I},
m AS (SELECT n.*, coalesce((SELECT max(id) FROM d WHERE d.user_id = n.user_id AND d.file_hash = n.file_hash), (SELECT max(id) FROM d WHERE n.file_name <> '' AND n.file_size > 0 AND d.user_id = n.user_id AND d.file_name = n.file_name AND d.file_size = n.file_size)) AS id FROM n),
u AS (SELECT * FROM m WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT id, {_FIELDS}, {TS.format('created_at')} AS created_at, 'kept' AS change FROM d WHERE id NOT IN (SELECT id FROM u) UNION ALL SELECT id, {_FIELDS}, {TS.format('created_at')}, 'updated' FROM u
UNION ALL SELECT (SELECT max(id) FROM d) + row_number() OVER (ORDER BY seq), {_FIELDS}, {TS.format('created_at')}, 'inserted' FROM m WHERE id IS NULL""",
    "dedup_keep_latest": f"""WITH d AS {D}, a AS (SELECT * FROM d d1 WHERE NOT EXISTS (SELECT 1 FROM d d2 WHERE d1.user_id = d2.user_id AND d1.file_hash = d2.file_hash AND d1.id < d2.id))
SELECT id, user_id, file_name FROM a a1 WHERE NOT EXISTS (SELECT 1 FROM a a2 WHERE a1.user_id = a2.user_id AND a1.file_name = a2.file_name AND a1.file_size = a2.file_size AND a1.id < a2.id)""",
    "ensure_session": f"""WITH x AS (SELECT session_id, user_id, title, created_at, updated_at AS seen, 0 AS seq FROM {S} UNION ALL SELECT session_id, user_id, 'New Chat', seen, seen, 1 FROM {_CALLS})
SELECT session_id, arg_max(user_id, (seq, seen, user_id)) AS user_id, arg_min(title, (seq, seen, user_id)) AS title, {TS.format('arg_min(created_at, (seq, seen, user_id))')} AS created_at, {TS.format('arg_max(seen, (seq, seen, user_id))')} AS updated_at FROM x GROUP BY session_id""",
    "append_messages": f"SELECT id, {_ALL} FROM {M} UNION ALL SELECT (SELECT max(id) FROM {M}) + row_number() OVER (ORDER BY id), session_id, user_id, 'assistant', 're: ' || content, NULL, '{{}}' FROM {M} WHERE role = 'user'",
    "say_sessions": f"""WITH c AS (SELECT session_id || CASE WHEN id % 2 = 0 THEN '' ELSE '_n' END AS session_id, user_id, TIMESTAMP '2024-02-01 00:00:00' + to_minutes(id) AS seen FROM {M} WHERE role = 'user'),
x AS (SELECT session_id, user_id, title, created_at, updated_at AS seen, 0 AS seq FROM {S} UNION ALL SELECT session_id, user_id, 'New Chat', seen, seen, 1 FROM c)
SELECT session_id, arg_max(user_id, (seq, seen, user_id)) AS user_id, arg_min(title, (seq, seen, user_id)) AS title, {TS.format('arg_min(created_at, (seq, seen, user_id))')} AS created_at, {TS.format('arg_max(seen, (seq, seen, user_id))')} AS updated_at FROM x GROUP BY session_id""",
    "rename_session": f"SELECT session_id, CASE WHEN session_id = 'session_3' AND user_id = 'user_3' THEN 'Hợp đồng' ELSE title END AS title FROM {S}",
    "auto_title": f"SELECT session_id, CASE WHEN length(t) > 40 THEN substr(t, 1, 40) || '...' ELSE t END AS title FROM (SELECT session_id, trim(replace(arg_min(coalesce(nullif(display_content, ''), content), id), '{store.MARK}', ''), ' ' || chr(10) || chr(9)) AS t FROM {M} GROUP BY session_id)",
    "delete_session": f"SELECT 'session' AS kind, session_id, CAST(NULL AS BIGINT) AS id FROM {S} WHERE user_id <> 'user_3' UNION ALL SELECT 'message', session_id, id FROM {M} WHERE session_id NOT IN (SELECT session_id FROM {S} WHERE user_id = 'user_3')",
    "clear_messages": f"SELECT id, session_id FROM {M} WHERE session_id <> 'session_4'",
    "content_hash": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
    "cache_partition": f"WITH k AS (SELECT user_id, file_hash, max(id) AS cached_id FROM {D} WHERE status = 'completed' AND file_hash IS NOT NULL GROUP BY ALL) SELECT seq, cached_id, CASE WHEN cached_id IS NULL THEN 'process' ELSE 'reuse' END AS action FROM {I} n LEFT JOIN k USING (user_id, file_hash)",
}
