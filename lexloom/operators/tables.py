"""Small jobs on chats and progress events."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import short_title


def chat_titles(turns: DataFrame, default: str = "New chat") -> DataFrame:
    """conv_id and the title from the first turn of the user."""
    first = turns.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"].alias("first"))
    return first.select("conv_id", F.coalesce(short_title(F.col("first")), F.lit(default)).alias("title"))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, aggregated before the shuffle."""
    rest = [c for c in events.columns if c not in (key, *order)]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("last")).select(key, "last.*")


def idle_sessions(events: DataFrame, key: str, at: str, minutes: int = 15) -> DataFrame:
    """Sessions of each key: a gap of at least `minutes` begins a new one."""
    w = Window.partitionBy(key).orderBy(at)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap: Column = micros - F.lag(micros).over(w)
    marked = events.select(key, at, F.when(gap < minutes * 60_000_000, 0).otherwise(1).alias("starts"))
    numbered = marked.withColumn("session", F.sum("starts").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n_events"))


#: Chats kept, characters of a title, and the title of a chat without one.
MOST_CHATS, MOST_TITLE, NO_TITLE = 100, 80, "New chat"


def load_chats(stored: DataFrame, now: int) -> DataFrame:
    """store_id, slot, id, title, created_at, updated_at, messages of the chats in each store's JSON text (store_id, json).

    What isn't as it should be is dropped, one element at a time: text that is no
    array, chats without a string id or an array of messages, messages without
    id, role, content and numeric time. The first MOST_CHATS stay.
    """
    one = lambda v, path: F.try_variant_get(v, path, "variant")
    kind = lambda v, path: F.schema_of_variant(one(v, path))
    text = lambda v, path: F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))
    number = lambda v, path: F.when(kind(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double").cast("long"))
    parts = lambda v, path: F.when(F.startswith(kind(v, path), F.lit("ARRAY")), F.try_variant_get(v, path, "array<variant>"))

    def message(v: Column) -> Column:
        return F.struct(text(v, "$.id").alias("id"), text(v, "$.role").alias("role"), text(v, "$.content").alias("content"), number(v, "$.createdAt").alias("created_at"))

    whole = lambda m: m["id"].isNotNull() & m["role"].isin("user", "assistant") & m["content"].isNotNull() & m["created_at"].isNotNull()
    chats = stored.select("store_id", F.posexplode(parts(F.try_parse_json("json"), "$")).alias("at", "v"))
    chats = chats.select("store_id", "at", text(F.col("v"), "$.id").alias("id"), parts(F.col("v"), "$.messages").alias("ms"), text(F.col("v"), "$.title").alias("title"), number(F.col("v"), "$.createdAt").alias("c"), number(F.col("v"), "$.updatedAt").alias("u"))
    chats = chats.filter("id is not null and ms is not null")
    # the chats of one store lie in one text
    chats = chats.withColumn("slot", F.row_number().over(Window.partitionBy("store_id").orderBy("at"))).filter(F.col("slot") <= MOST_CHATS)
    title = F.when(F.trim("title") != "", F.col("title")).otherwise(NO_TITLE)
    return chats.select("store_id", "slot", "id", title.alias("title"), F.coalesce("c", F.lit(now)).alias("created_at"), F.coalesce("u", F.lit(now)).alias("updated_at"), F.filter(F.transform("ms", message), whole).alias("messages"))


def save_chats(chats: DataFrame) -> DataFrame:
    """store_id and json: the chats with a message, the first MOST_CHATS in their order."""
    kept = chats.filter(F.size("messages") > 0).withColumn("turn", F.row_number().over(Window.partitionBy("store_id").orderBy("slot"))).filter(F.col("turn") <= MOST_CHATS)
    camel = F.transform("messages", lambda m: F.struct(m["id"].alias("id"), m["role"].alias("role"), m["content"].alias("content"), m["created_at"].alias("createdAt")))
    chat = F.struct("turn", F.struct("id", "title", F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"), camel.alias("messages")).alias("chat"))
    return kept.groupBy("store_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(chat)), lambda x: x["chat"])).alias("json"))  # at most MOST_CHATS


def rename_chats(chats: DataFrame, new: DataFrame) -> DataFrame:
    """chats (id, title, ...) with the titles of new (id, typed): blanks collapsed, at most MOST_TITLE characters; a blank one keeps the old title. Of several for one id the greatest counts."""
    new = new.groupBy("id").agg(F.max("typed").alias("typed"))
    clean = F.substring(F.trim(F.regexp_replace("typed", r"(?U)\s+", " ")), 1, MOST_TITLE)
    return chats.join(new, "id", "left").withColumn("title", F.coalesce(F.nullif(clean, F.lit("")), "title")).drop("typed")


def delete_chats(chats: DataFrame, gone: DataFrame) -> DataFrame:
    return chats.join(gone.select("id"), "id", "left_anti")


def recent_chats(chats: DataFrame, now: Column) -> DataFrame:
    """chats with their bucket, the latest first."""
    return chats.withColumn("bucket", recency(F.timestamp_millis("updated_at"), now)).orderBy(F.desc("updated_at"), "id")


def recency(at: Column, now: Column) -> Column:
    """Under a day, under a week, or older."""
    age = F.unix_micros(now) - F.unix_micros(at.cast("timestamp"))
    day = 86_400_000_000
    return F.when(age < day, "today").when(age < 7 * day, "week").otherwise("older")
