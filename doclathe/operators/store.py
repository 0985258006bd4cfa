"""Document store: lookups and listings, and mutations as snapshots (frame in, frame out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import ranked

DEFAULT_USER = "default_user"
MARK = "[HỆ THỐNG]:"


def _only(df: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def stamp(at: str) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


# Lookups


def parsed(json: str) -> Column:
    """Whether a string is JSON; what isn't is kept as it is."""
    return F.try_parse_json(json).isNotNull()


def latest_by_hash(docs: DataFrame) -> DataFrame:
    """For each user and content hash, the completed document of greatest id. Null and empty hashes find nothing."""
    found = docs.where((F.col("status") == "completed") & (F.coalesce("file_hash", F.lit("")) != ""))
    best = found.groupBy("user_id", "file_hash").agg(F.max("id").alias("id"), F.max_by("file_name", "id").alias("file_name"), F.max_by("ocr_data_json", "id").alias("ocr_data_json"))
    return best.withColumn("is_json", parsed("ocr_data_json"))


def latest_by_name(docs: DataFrame) -> DataFrame:
    """For each user and file name, the document of greatest id, of any status."""
    return docs.groupBy("user_id", "file_name").agg(F.max("id").alias("id"), F.max_by("status", "id").alias("status"))


def doc_by_id(docs: DataFrame, doc_id: int, user_id: str | None = None) -> DataFrame:
    return _only(docs.where(F.col("id") == doc_id), user_id=user_id).limit(1)


def list_documents(docs: DataFrame, user_id: str | None = None, category: str | None = None, limit: int = 100) -> DataFrame:
    """The newest documents, without their texts."""
    found = _only(docs, user_id=user_id, category=category)
    return found.select("id", "user_id", "file_name", "file_size", "file_type", "category", "status", stamp("created_at").alias("created_at")).orderBy(F.desc("id")).limit(limit)


def file_list_view(docs: DataFrame, user_id: str | None = None, limit: int = 500) -> DataFrame:
    """The listing as shown: empty values get defaults, the type comes from the name if it must."""
    rows = list_documents(docs, user_id=user_id, limit=limit)
    name = F.coalesce(F.nullif("file_name", F.lit("")), F.lit("document"))
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    kind = F.coalesce(F.nullif("file_type", F.lit("")), F.nullif(ext, F.lit("")), F.lit(".pdf"))
    return rows.select("id", name.alias("name"), F.coalesce(F.nullif("file_size", F.lit(0)), F.lit(1024)).cast("long").alias("size"), kind.alias("type"), "category", F.col("created_at").alias("updated_at"))


def resolve_documents(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Each request (ask_id, user_id, doc_id, name): by id for the user, then for anyone, then by name likewise.

    The document of greatest id wins among equals; requests that nothing matches have a null id.
    """
    best = docs.groupBy("file_name").agg(F.max("id").alias("name_any"))
    mine = docs.groupBy("file_name", "user_id").agg(F.max("id").alias("name_own"))
    ids = docs.select(F.col("id").alias("by_id"), F.col("user_id").alias("owner"))
    out = asked.join(ids, asked.doc_id == ids.by_id, "left")
    out = out.join(mine.select(F.col("file_name").alias("name"), "user_id", "name_own"), ["name", "user_id"], "left").join(best.select(F.col("file_name").alias("name"), "name_any"), "name", "left")
    step = F.when(F.col("by_id").isNotNull() & (F.col("owner") == F.col("user_id")), "own id").when(F.col("by_id").isNotNull(), "any id").when(F.col("name_own").isNotNull(), "own name").when(F.col("name_any").isNotNull(), "any name")
    return out.select("ask_id", F.coalesce("by_id", "name_own", "name_any").alias("id"), step.alias("step"))


def chat_history(messages: DataFrame, session_id: str, user_id: str | None = None) -> DataFrame:
    rows = messages.where(F.col("session_id") == session_id)
    if user_id:
        rows = rows.where((F.col("user_id") == user_id) | (F.col("user_id") == DEFAULT_USER))
    return rows.select("id", "role", "content", F.nullif("display_content", F.lit("")).alias("display_content"), F.nullif("doc_result_json", F.lit("")).alias("doc_result_json")).orderBy("id")


def session_listing(sessions: DataFrame, messages: DataFrame, user_id: str | None = None) -> DataFrame:
    """Sessions with their number of messages and the last one's text, the most recent first."""
    rows = _only(sessions, user_id=user_id)
    said = messages.groupBy("session_id").agg(F.count("id").alias("message_count"), F.max_by(F.coalesce("display_content", "content"), "id").alias("last_message"))
    out = rows.join(said, "session_id", "left")
    return out.select("session_id", "user_id", "title", stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"), F.coalesce("message_count", F.lit(0)).cast("long").alias("message_count"), "last_message").orderBy(F.desc("updated_at"), "session_id")


def last_doc_in_session(messages: DataFrame) -> DataFrame:
    found = messages.where(F.coalesce("doc_result_json", F.lit("")) != "")
    return found.groupBy("session_id").agg(F.max("id").alias("id"), F.max_by("doc_result_json", "id").alias("doc_result_json"))


def resolve_identity(*ways: Column | str) -> Column:
    """The first that is neither null nor empty, else the default user."""
    return F.coalesce(*[F.nullif(F.col(w) if isinstance(w, str) else w, F.lit("")) for w in ways], F.lit(DEFAULT_USER))


# Mutations


#: What a stored document has where a new row says nothing.
DOCUMENT_DEFAULTS = {"file_size": 0, "file_type": "", "category": "unclassified", "extracted_text": "", "eval_report": "", "status": "completed"}


def _whole(rows: DataFrame, like: DataFrame, defaults: dict) -> list[Column]:
    """The columns of `like` but for its id, from rows that may lack some of them."""
    return [(F.col(f.name) if f.name in rows.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in like.schema if f.name != "id"]


def upsert_documents(docs: DataFrame, new: DataFrame) -> DataFrame:
    """The store after new rows were put in: all its columns, and `change`: kept, updated or inserted.

    New rows have seq and any columns of the store, created_at being the time of the call; what
    they lack has its default, and a null or empty user is the default user. A row replaces all
    columns of the document of its user with the same hash, else with the same name and size
    (a hash, a name and a size above 0 are needed), the greatest id winning; else it gets a
    new id, in the order of seq. If several match one document, the last by seq stays. Keys
    alone are matched and ranked; the documents themselves are joined once by seq.
    """
    new = new.withColumn("user_id", resolve_identity("user_id")).select("seq", *_whole(new, docs, DOCUMENT_DEFAULTS))
    keys = new.select("seq", "user_id", F.nullif("file_hash", F.lit("")).alias("file_hash"), F.nullif("file_name", F.lit("")).alias("file_name"), F.when(F.col("file_size") > 0, F.col("file_size")).alias("file_size"))
    by_hash = docs.where("file_hash <> ''").groupBy("user_id", "file_hash").agg(F.max("id").alias("id_hash"))
    by_name = docs.where("file_name <> '' and file_size > 0").groupBy("user_id", "file_name", "file_size").agg(F.max("id").alias("id_name"))
    met = keys.join(by_hash, ["user_id", "file_hash"], "left").join(by_name, ["user_id", "file_name", "file_size"], "left").select("seq", F.coalesce("id_hash", "id_name").alias("id"))
    changed = met.where("id is not null").groupBy("id").agg(F.max("seq").alias("seq")).select("seq", "id", F.lit("updated").alias("change"))
    placed = changed.unionByName(_numbered(met.where("id is null").select("seq"), docs).withColumn("change", F.lit("inserted")))
    rest = [c for c in docs.columns if c != "id"]
    kept = docs.join(changed.select("id"), "id", "left_anti").select("id", *rest, F.lit("kept").alias("change"))
    return kept.unionByName(new.join(placed, "seq").select("id", *rest, "change"))


def _numbered(new: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (seq, id): new ids by seq, from the greatest id held, which is one number for the driver."""
    top = held.agg(F.max("id")).first()[0] or 0
    return ranked(new, "seq").select("seq", (F.col("rank") + 1 + top).alias("id"))


def dedup_keep_latest(docs: DataFrame) -> DataFrame:
    """Of documents with equal user and hash the greatest id stays, then likewise for user, name and size. Nulls never match."""
    left = docs
    for keys in (("user_id", "file_hash"), ("user_id", "file_name", "file_size")):
        # ids and keys alone are shuffled, and without nulls, so no key holds them all
        known = left.select("id", *keys).dropna(subset=list(keys))
        top = known.groupBy(*keys).agg(F.max("id").alias("top"))
        gone = known.join(top, list(keys)).where("id < top").select("id")
        left = left.join(gone, "id", "left_anti")
    return left


def ensure_sessions(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """Sessions after calls (session_id, user_id, at): new ones are made, known ones change owner and time, not title."""
    old = sessions.select("session_id", "user_id", "title", "created_at", F.col("updated_at").alias("at"), F.lit(0).alias("seq"))
    new = calls.select("session_id", "user_id", F.lit("New Chat").alias("title"), F.col("at").alias("created_at"), "at", F.lit(1).alias("seq"))
    order = F.struct("seq", "at", "user_id")
    return old.unionByName(new).groupBy("session_id").agg(F.max_by("user_id", order).alias("user_id"), F.min_by("title", order).alias("title"), F.min_by("created_at", order).alias("created_at"), F.max_by("at", order).alias("updated_at"))


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Messages with new ones added under new ids, in the order of seq; all columns of the messages stay.

    New rows have seq and any columns; a null or empty user is the default user.
    """
    new = new.withColumn("user_id", resolve_identity("user_id")).select("seq", *_whole(new, messages, {}))
    return messages.unionByName(new.join(_numbered(new.select("seq"), messages), "seq").select(*messages.columns))


def say(sessions: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages after new messages (with `at`, the time of the call): each makes sure of its session first."""
    calls = new.select("session_id", resolve_identity("user_id").alias("user_id"), "at").where("session_id IS NOT NULL")
    return ensure_sessions(sessions, calls), append_messages(messages, new)


def rename_session(sessions: DataFrame, session_id: str, title: str, user_id: str | None = None) -> DataFrame:
    hit = F.col("session_id") == session_id
    if user_id:
        hit = hit & (F.col("user_id") == user_id)
    return sessions.withColumn("title", F.when(hit, title).otherwise(F.col("title")))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def auto_titles(messages: DataFrame) -> DataFrame:
    """A title for each session: its first message without the system mark, cut at 40 characters."""
    said = F.coalesce(F.nullif("display_content", F.lit("")), "content")
    first = messages.groupBy("session_id").agg(F.min_by(said, "id").alias("t"))
    clean = F.regexp_replace(F.replace("t", F.lit(MARK), F.lit("")), r"(?U)^\s+|\s+$", "")
    return first.select("session_id", clean.alias("t")).select("session_id", shortened(F.col("t"), 40).alias("title"))


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without the sessions named in gone (session_id, user_id); messages go with their session."""
    left = sessions.join(gone, ["session_id", "user_id"], "left_anti")
    dropped = sessions.join(gone, ["session_id", "user_id"], "left_semi").select("session_id")
    return left, messages.join(dropped, "session_id", "left_anti")


def clear_messages(messages: DataFrame, session_id: str, user_id: str | None = None) -> DataFrame:
    hit = F.col("session_id") == session_id
    if user_id:
        hit = hit & (F.coalesce("user_id", F.lit("")) == user_id)
    return messages.where(~F.coalesce(hit, F.lit(False)))


def cache_partition(new: DataFrame, docs: DataFrame) -> DataFrame:
    """New rows (seq, user_id, file_hash) with the stored document to reuse, or none."""
    known = docs.where((F.col("status") == "completed") & F.col("file_hash").isNotNull()).groupBy("user_id", "file_hash").agg(F.max("id").alias("cached_id"))
    return new.join(known, ["user_id", "file_hash"], "left").select("seq", "cached_id", F.when(F.col("cached_id").isNotNull(), "reuse").otherwise("process").alias("action"))
