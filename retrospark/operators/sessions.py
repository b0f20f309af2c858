"""From messages to sessions, exchanges and chunks.

messages: session_id, line, uuid, parent_uuid, type, is_sidechain, ts_text, text (visible), blocks (array of struct(role,
text)), and session_ref and title where a source has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrospark import lexicons
from retrospark.config import Settings
from retrospark.functions import text as T

NO_BLOCKS = "array<struct<role:string,text:string>>"


def talk(messages: DataFrame) -> DataFrame:
    """User and assistant messages outside side chains."""
    return messages.filter(F.col("type").isin("user", "assistant") & ~F.coalesce("is_sidechain", F.lit(False)))


def pair_exchanges(messages: DataFrame) -> DataFrame:
    """One row for each exchange: session_id, exchange_idx, and columns user_* and asst_* (null for a missing side).

    An assistant message pairs with the user message it names as parent; of several, the first by time, then line. All
    others stand alone. Exchanges are in order of their first side's time text, then pairs first, then line.
    """
    rows = talk(messages).withColumn("key", F.coalesce("ts_text", F.lit("")))
    side = lambda kind, name: rows.filter(F.col("type") == kind).select("session_id", *[F.col(c).alias(f"{name}_{c}") for c in ("line", "uuid", "parent_uuid", "ts_text", "text", "key")])
    user, asst = side("user", "user"), side("assistant", "asst")
    met = user.filter("user_uuid is not null").join(asst.withColumnRenamed("session_id", "s"), (F.col("session_id") == F.col("s")) & (F.col("user_uuid") == F.col("asst_parent_uuid"))).drop("s")
    first = Window.partitionBy("session_id", "user_uuid").orderBy("asst_key", "asst_line", F.desc("user_line"))
    pairs = met.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    alone_user = user.join(pairs.select("session_id", "user_uuid"), ["session_id", "user_uuid"], "left_anti")
    alone_asst = asst.join(pairs.select("session_id", "asst_line"), ["session_id", "asst_line"], "left_anti")
    everything = pairs.withColumn("alone", F.lit(0)).unionByName(alone_user.withColumn("alone", F.lit(1)), allowMissingColumns=True).unionByName(alone_asst.withColumn("alone", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("session_id").orderBy(F.coalesce("user_key", "asst_key"), "alone", F.coalesce("user_line", "asst_line"))
    return everything.withColumn("exchange_idx", F.row_number().over(order) - 1).drop("user_key", "asst_key", "alone", "user_parent_uuid", "asst_parent_uuid")


def exchanges(messages: DataFrame) -> DataFrame:
    """session_id, exchange_idx, role, content, ts_text, line_start, line_end; exchanges without text are gone, but count."""
    u, a = F.coalesce("user_text", F.lit("")), F.coalesce("asst_text", F.lit(""))
    label = lambda name, text: F.when(text != "", F.concat(F.lit(f"[{name}]: "), text))
    role = F.when((u != "") & (a != ""), "exchange").when(u != "", "user").otherwise("assistant")
    own_time = T.parse_timestamp(F.col("user_ts_text"))
    ts = F.when(own_time.isNotNull(), F.col("user_ts_text")).otherwise(F.col("asst_ts_text"))
    return pair_exchanges(messages).filter((u != "") | (a != "")).select(
        "session_id", "exchange_idx", role.alias("role"), F.concat_ws("\n\n", label(lexicons.USER_LABEL, u), label(lexicons.ASSISTANT_LABEL, a)).alias("content"), ts.alias("ts_text"),
        F.when(F.col("user_uuid").isNotNull(), F.col("user_line")).alias("line_start"), F.when(F.col("asst_uuid").isNotNull(), F.col("asst_line")).alias("line_end"),
    )


def chunks(messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """session_id, chunk_index, role, content, ts, line_start, line_end, metadata: exchanges first, then selected blocks."""
    cut = lambda c: F.posexplode(T.chunk_text(F.col(c), settings.chunk_chars, settings.overlap_chars))
    one = exchanges(messages).select("session_id", F.lit(1).alias("pass"), F.col("exchange_idx").alias("ord"), F.lit(0).alias("block"), "role", "ts_text", "line_start", "line_end", cut("content").alias("sub", "content"))
    one = one.withColumn("metadata", F.create_map(F.lit("exchange_idx"), F.col("ord").cast("string"), F.lit("sub_chunk"), F.col("sub").cast("string")))
    answers = talk(messages).filter("type = 'assistant'").select("session_id", "line", "uuid", "ts_text", F.posexplode("blocks").alias("block", "b"))
    number = Window.partitionBy("session_id").orderBy(F.coalesce("ts_text", F.lit("")), "line", "block")
    own_line = F.when(F.col("uuid").isNotNull(), F.col("line"))
    two = answers.withColumn("ord", F.row_number().over(number)).select("session_id", F.lit(2).alias("pass"), "ord", "block", F.col("b.role").alias("role"), "ts_text", own_line.alias("line_start"), own_line.alias("line_end"), F.col("b.text").alias("whole"))
    two = two.select("*", cut("whole").alias("sub", "content")).drop("whole").withColumn("metadata", F.create_map(F.lit("source"), F.col("role"), F.lit("sub_chunk"), F.col("sub").cast("string")))
    order = Window.partitionBy("session_id").orderBy("pass", "ord", "sub")
    return one.unionByName(two).withColumn("chunk_index", F.row_number().over(order) - 1).select("session_id", "chunk_index", "role", "content", T.parse_timestamp(F.col("ts_text")).alias("ts"), "line_start", "line_end", "metadata")


def with_chunk_ids(chunks: DataFrame, *order: str) -> DataFrame:
    """chunk_id: a dense number over the given columns. Ranges are numbered apart, after one count for each range."""
    from retrospark.storage import materialize

    order = order or ("session_id", "chunk_index")
    parts = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(chunks.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(offsets, "__part").withColumn("chunk_id", F.col("__before") + place - 1).drop("__part", "__before")


def session_metadata(messages: DataFrame) -> DataFrame:
    """session_id, title, started_ts_text, ended_ts_text, user_messages, asst_messages.

    The start is that of the first system entry, the end the last parsable time in file order.
    """
    has = set(messages.columns)
    title = F.col("title") if "title" in has else F.lit(None).cast("string")
    good = T.parse_timestamp(F.col("ts_text")).isNotNull()
    main = ~F.coalesce("is_sidechain", F.lit(False))
    rows = messages.withColumn("__title", title)
    out = rows.groupBy("session_id").agg(
        F.min_by("__title", F.when((F.col("type") == "custom-title") & (F.col("__title") != ""), F.col("line"))).alias("title"),
        F.min_by("ts_text", F.when(F.col("type") == "system", F.col("line"))).alias("started_ts_text"),
        F.max_by("ts_text", F.when(good, F.col("line"))).alias("ended_ts_text"),
        F.count_if((F.col("type") == "user") & main).alias("user_messages"),
        F.count_if((F.col("type") == "assistant") & main).alias("asst_messages"),
    )
    return out.withColumn("title", F.coalesce("title", F.concat(F.lit("Sessão "), F.substr("session_id", F.lit(1), F.lit(8)))))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Messages of a table (conv_id, turn, role, text): each turn answers the turn before it."""
    sid = F.concat(F.lit("conv-"), F.lpad(F.col("conv_id").cast("string"), 8, "0"))
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return conversations.select(
        sid.alias("session_id"), (F.col("turn") + 1).cast("int").alias("line"), F.concat_ws("-", sid, F.col("turn").cast("string")).alias("uuid"),
        F.when(F.col("turn") > 0, F.concat_ws("-", sid, (F.col("turn") - 1).cast("string"))).alias("parent_uuid"), F.col("role").alias("type"), F.lit(False).alias("is_sidechain"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_text"), T.strip(F.coalesce("text", F.lit(""))).alias("text"), F.array().cast(NO_BLOCKS).alias("blocks"),
    )
