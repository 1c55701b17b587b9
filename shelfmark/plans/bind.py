"""Item, collection, membership, run and status tables derived from the driver's parquet tables.

``Library`` builds them as DataFrames; ``views_sql`` gives the same tables as DuckDB common table
expressions for the side-by-side check.  Flags derive from the rows' own values and cover whole tables.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.session import landed, ship_package

_SHARED: dict[tuple, DataFrame] = {}

TEXT_TABLES = ("documents", "pages")
SOURCES = ("documents", "pages", "conversations", "orders", "lineitem", "part", "embeddings")   # what the shared tables are made of
AS_OF = "2024-02-01 00:00:00"

PROSE_EPOCH = 1685577600      # 2023-06-01
CHAT_EPOCH = 1693526400       # 2023-09-01
WEB_EPOCH = 1696118400        # 2023-10-01
RECEIPT_ID, CHAT_ID, WEB_ID = 1_000_000_000_000, 2_000_000_000_000, 3_000_000_000_000

EVENT_STATUS = (("click", "completed"), ("error", "failed"), ("purchase", "processing"),
                ("signup", "pending"), ("view", "inaccessible"))


def cell(lang: str, number: int) -> int:
    """Collection id of a language and source number."""
    return 1 + number * 1000 + (ord(lang[0]) - 97) * 26 + ord(lang[1]) - 97


def _letters() -> F.Column:
    return (F.ascii(F.substring("lang", 1, 1)) - 97) * 26 + F.ascii(F.substring("lang", 2, 1)) - 97


def _seconds(column) -> F.Column:
    return F.timestamp_seconds(column)


class Library:
    """The bound tables of one data folder.  Every attribute is a lazy DataFrame over whole tables."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A whole table.  The rules over texts cost far more than reading them: where the files make fewer tasks than there are cores,
        texts are dealt out to all of them; larger tables are used as they are read."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores else df

    @cached_property
    def stamp(self) -> tuple:
        """Which files the tables consist of, and when they last changed."""
        context, seen = self.spark.sparkContext, []
        for name in SOURCES:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
            store = path.getFileSystem(context._jsc.hadoopConfiguration())
            seen += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in store.listStatus(path)]
        return tuple(seen)

    def shared(self, name: str, build) -> DataFrame:
        """A derived table that several queries read: written once per application and state of the tables."""
        key = (self.spark.sparkContext.applicationId, self.folder, name, self.stamp)
        if key not in _SHARED:
            _SHARED[key] = landed(build(), name)
        return _SHARED[key]

    def lazy(self, name: str, build) -> DataFrame:
        """Like ``shared``, but what ``build`` returns isn't written: each query works out only the columns that it asks for."""
        key = (self.spark.sparkContext.applicationId, self.folder, name, self.stamp)
        if key not in _SHARED:
            _SHARED[key] = build()
        return _SHARED[key]

    @property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp")

    @cached_property
    def prose(self) -> DataFrame:
        n = F.col("n_chars")
        return self.table("documents").select(
            F.col("doc_id").alias("item_id"),
            F.concat(F.lit("asset-"), F.col("doc_id").cast("string")).alias("external_id"),
            F.col("text").alias("ocr_text"),
            F.when(n.between(1400, 1450), None)
            .otherwise(_seconds(F.lit(PROSE_EPOCH) + F.col("doc_id") * 24000)).alias("created_at"),
            _seconds(F.lit(PROSE_EPOCH) + n).alias("imported_at"),
            n.between(1000, 1300).alias("is_favorite"),
            (n < 100).alias("is_removed"),
            F.when(n > 6000, "inaccessible").otherwise("available").alias("access_state"),
            F.concat_ws(" ", "lang", "source").alias("collection_key"),
        )

    @cached_property
    def receipts(self) -> DataFrame:
        tax = self.table("lineitem").groupBy("l_orderkey").agg(
            F.sum((F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(18,4)")).alias("tax"))
        key = F.col("o_orderkey").cast("string")
        money = lambda c: F.col(c).cast("decimal(14,2)").cast("string")
        text = F.concat(
            F.lit("Receipt #"), key, F.lit("\nSubtotal $"), money("o_totalprice"), F.lit("\nTax $"), money("tax"),
            F.lit("\nBooking reference OD"), key, F.lit("\n"), F.col("o_orderpriority"))
        # The join shuffles by this key anyway; the fixed count keeps its small output spread for the text rules.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return (
            self.table("orders").repartition(parts, "o_orderkey").join(tax, F.col("o_orderkey") == F.col("l_orderkey"))
            .select((F.lit(RECEIPT_ID) + F.col("o_orderkey")).alias("item_id"), text.alias("ocr_text"),
                    F.col("o_orderdate").cast("timestamp").alias("created_at"))
        )

    @cached_property
    def chats(self) -> DataFrame:
        line = F.concat(F.lit("04:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("\n"),
                        F.col("role"), F.lit(": "), F.col("text"))
        return (
            self.table("conversations").withColumn("line", line).groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("turns"))
            .select((F.lit(CHAT_ID) + F.col("conv_id")).alias("item_id"),
                    F.array_join(F.col("turns.line"), "\n").alias("ocr_text"),
                    _seconds(F.lit(CHAT_EPOCH) + F.col("conv_id") * 5400).alias("created_at"))
        )

    @cached_property
    def web(self) -> DataFrame:
        plain = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ ]+", " ")
        return self.table("pages").select(
            (F.lit(WEB_ID) + F.col("page_id")).alias("item_id"),
            F.concat(F.col("url"), F.lit("\n"), F.trim(plain)).alias("ocr_text"),
            _seconds(F.lit(WEB_EPOCH) + F.col("page_id") * 3600).alias("created_at"))

    @cached_property
    def items(self) -> DataFrame:
        """All four kinds of text items, with the pool they belong to."""
        parts = []
        for pool, df in (("prose", self.prose), ("receipt", self.receipts), ("chat", self.chats), ("web", self.web)):
            parts.append(df.select("item_id", F.lit(pool).alias("pool_key"), "ocr_text", "created_at"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    @cached_property
    def collections(self) -> DataFrame:
        """Row 0 is the review inbox; one collection per language and source; one per benchmark passage."""
        number = F.regexp_extract("source", "([0-9]+)$", 1).cast("bigint")
        base = self.table("documents").select("lang", "source").distinct()
        cell = base.select(
            (F.lit(1) + number * 1000 + _letters()).alias("collection_id"),
            F.when(F.col("source") == "src0", "userContext").otherwise("aiContext").alias("kind"),
            F.concat_ws(" ", "lang", "source").alias("title"),
            (F.col("source") == "src19").alias("is_archived"),
            (F.col("source") == "src1").alias("is_pinned"),
            F.when(F.col("source") == "src0", "user").otherwise("ai").alias("created_by"),
            _seconds(F.lit(PROSE_EPOCH) + number * 86400).alias("created_at"))
        words = F.slice(F.split(F.trim("text"), r"\s+"), 1, 4)
        passage = self.table("benchmark").select(
            (F.lit(1_000_000_000) + F.col("item_id")).alias("collection_id"), F.lit("aiContext").alias("kind"),
            F.array_join(words, " ").alias("title"), F.lit(False).alias("is_archived"),
            F.lit(False).alias("is_pinned"), F.lit("ai").alias("created_by"),
            _seconds(F.lit(PROSE_EPOCH) + F.col("item_id") * 3600).alias("created_at"))
        inbox = self.spark.range(1).select(
            F.col("id").alias("collection_id"), F.lit("unassigned").alias("kind"), F.lit("Review").alias("title"),
            F.lit(False).alias("is_archived"), F.lit(False).alias("is_pinned"), F.lit("ai").alias("created_by"),
            _seconds(F.lit(PROSE_EPOCH)).alias("created_at"))
        return inbox.unionByName(cell).unionByName(passage)

    @cached_property
    def cells(self) -> DataFrame:
        """Collections with a list position, as stored tables carry one."""
        return self.collections.withColumn("sort_order", F.col("collection_id") % 7)

    @cached_property
    def aliases(self) -> DataFrame:
        """One alias per collection: its title words turned round."""
        turned = F.array_join(F.reverse(F.split("title", " ")), " ")
        return self.collections.filter("kind <> 'unassigned'").select(
            "collection_id", turned.alias("alias_title"), F.lower(turned).alias("normalized_alias"), "created_at")

    @cached_property
    def dup_members(self) -> DataFrame:
        """Stored duplicate groups: items with the same text, in id order within a group."""
        docs = self.table("documents")
        return docs.select(F.md5("text").alias("group_id"), F.col("doc_id").alias("item_id"), F.col("doc_id").alias("position"))

    @cached_property
    def memberships(self) -> DataFrame:
        """Documents without a good label wait in review; the rest belong to their cell; mid-length ones to two."""
        docs = self.table("documents").join(
            self.table("labels").withColumnRenamed("doc_id", "label_doc"), F.col("doc_id") == F.col("label_doc"), "left")
        number = F.regexp_extract("source", "([0-9]+)$", 1).cast("bigint")
        place = F.lit(1) + number * 1000 + _letters()
        good = F.coalesce(F.col("quality"), F.lit(1)) == 1
        no_score = F.lit(None).cast("double")
        when = _seconds(F.lit(PROSE_EPOCH) + F.col("n_chars"))
        main = docs.filter(good).select(
            F.col("doc_id").alias("item_id"), place.alias("collection_id"),
            F.when(F.col("toxic") == 1, "user").otherwise("ai").alias("source"),
            F.round(F.lit(0.7) + F.least(F.col("n_chars"), F.lit(20000)) / F.lit(100000.0), 6).alias("confidence"),
            when.alias("created_at"), F.col("doc_id").alias("position"))
        review = docs.filter(~good).select(
            F.col("doc_id").alias("item_id"), F.lit(0).cast("bigint").alias("collection_id"), F.lit("user").alias("source"),
            no_score.alias("confidence"), when.alias("created_at"), F.col("doc_id").alias("position"))
        extra = docs.filter(good & F.col("n_chars").between(2000, 2400) & (F.col("source") != "src2")).select(
            F.col("doc_id").alias("item_id"), (F.lit(2001) + _letters()).cast("bigint").alias("collection_id"),
            F.lit("user").alias("source"), no_score.alias("confidence"), when.alias("created_at"),
            F.col("doc_id").alias("position"))
        return main.unionByName(review).unionByName(extra)

    @cached_property
    def runs(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("run_id"), F.col("user_id").alias("item_id"),
            F.col("ts").cast("timestamp").alias("started_at"),
            F.when(kind == "click", "reuse").when(kind == "purchase", "create").when(kind == "view", "needsReview")
            .otherwise(F.lit(None).cast("string")).alias("decision"),
            F.when(kind == "error", F.concat(F.lit("code_"), F.floor(F.col("value")).cast("string")))
            .otherwise(F.lit(None).cast("string")).alias("error_code"),
            F.when(F.col("value") < 20, "ondevice-rules").otherwise("cloud-model").alias("provider"))

    @cached_property
    def evals(self) -> DataFrame:
        q, t = F.col("quality") == 1, F.col("toxic") == 1
        return self.table("labels").select(
            F.col("doc_id").alias("item_id"),
            F.when(q & ~t, "correct").when(q, "wrongCollection").when(t, "shouldBeNeedsReview")
            .otherwise("wrongCollectionName").alias("label"))

    @cached_property
    def asset_list(self) -> DataFrame:
        """Assets a device reports: most stored ones, later by an hour, and those of the orders table."""
        stored = self.table("events").filter(F.col("event_type").isin("click", "view", "purchase")).select(
            F.concat(F.lit("asset-"), F.col("event_id").cast("string")).alias("external_id"),
            (F.col("ts").cast("timestamp") + F.expr("interval 1 hour")).alias("created_at"), F.lit(1170).alias("width"),
            F.lit(2532).alias("height"), F.lit(True).alias("is_screenshot"))
        ordered = self.table("orders").select(
            F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("external_id"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            (F.col("o_custkey") % 3000 + 1).cast("int").alias("width"), F.lit(2532).alias("height"),
            (F.col("o_orderpriority") == "1-URGENT").alias("is_screenshot"))
        return stored.unionByName(ordered)

    @cached_property
    def stages(self) -> DataFrame:
        """One status row per event: two processing stages, the organise stage and their bookkeeping."""
        status = F.lit(None).cast("string")
        for kind, name in EVENT_STATUS:
            status = F.when(F.col("event_type") == kind, name).otherwise(status)
        v = F.col("value")
        visual = (F.when(v < 8, "pending").when(v < 16, "processing").when(v < 45, "completed")
                  .when(v < 70, "failed").otherwise("inaccessible"))
        organize = (F.when(v < 5, "idle").when(v < 12, "pending").when(v < 25, "pendingNetwork").when(v < 40, "ready")
                    .when(v < 60, "failed").when(v < 80, "skippedNoConsent").otherwise("idle"))
        failed = F.col("event_type") == "error"
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(
            F.col("event_id").alias("item_id"),
            F.when(F.col("user_id") < 5, None).otherwise(F.concat(F.lit("asset-"), F.col("event_id").cast("string"))).alias("external_id"),
            F.when(v < 90, "photos").otherwise("fixture").alias("source"), ts.alias("created_at"),
            ts.alias("updated_at"), (v > 60).alias("is_removed"),
            F.when((v > 30) & (v < 36), "inaccessible").otherwise("available").alias("access_state"),
            status.alias("ocr_status"), F.when(v < 10, 1).otherwise(2).cast("int").alias("ocr_version"),
            F.when(failed, F.floor(v / 10) + 1).otherwise(0).cast("int").alias("ocr_attempts"),
            F.when(status == "processing", ts).otherwise(F.lit(None).cast("timestamp")).alias("ocr_claimed_at"),
            F.when(failed & (v < 50), ts + F.expr("interval 1 hour")).otherwise(F.lit(None).cast("timestamp")).alias("ocr_next_retry_at"),
            F.when(failed & (v > 3), F.concat(F.lit("code_"), F.floor(v).cast("string"))).otherwise(F.lit(None).cast("string")).alias("ocr_error"),
            visual.alias("visual_status"), F.lit(1).cast("int").alias("visual_version"),
            F.when(visual == "processing", ts).otherwise(F.lit(None).cast("timestamp")).alias("visual_claimed_at"),
            F.when(visual == "failed", F.floor(v / 20)).otherwise(0).cast("int").alias("visual_attempts"),
            organize.alias("organize_status"), (F.col("user_id") > 130).alias("organize_locked"),
            F.when(organize == "ready", F.lit(2)).when(organize == "failed", F.lit(1)).otherwise(F.lit(None)).cast("int").alias("resolver_version"),
            F.concat(F.lit("fp-"), F.col("event_id").cast("string")).alias("fingerprint"))


VIEWS_SQL_LISTING = """
select 'asset-' || event_id as external_id, ts + interval 1 hour as created_at, 1170 as width, 2532 as height, true as is_screenshot
from events where event_type in ('click', 'view', 'purchase')
union all
select 'order-' || o_orderkey, o_orderdate, o_custkey % 3000 + 1, 2532, o_orderpriority = '1-URGENT' from orders"""
_LETTERS = "(ascii(lang) - 97) * 26 + ascii(lang[2:2]) - 97"
_CELL = f"1 + cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) * 1000 + {_LETTERS}"
_STATUS = "case event_type " + " ".join(f"when '{k}' then '{s}'" for k, s in EVENT_STATUS) + " end"
_VISUAL = ("case when value < 8 then 'pending' when value < 16 then 'processing' when value < 45 then 'completed' "
           "when value < 70 then 'failed' else 'inaccessible' end")
_ORGANIZE = ("case when value < 5 then 'idle' when value < 12 then 'pending' when value < 25 then 'pendingNetwork' "
             "when value < 40 then 'ready' when value < 60 then 'failed' when value < 80 then 'skippedNoConsent' "
             "else 'idle' end")

VIEWS_SQL = {
    "v_prose": f"""
select doc_id as item_id, concat('asset-', doc_id) as external_id, text as ocr_text,
  case when n_chars between 1400 and 1450 then null
       else make_timestamp(({PROSE_EPOCH} + doc_id * 24000) * 1000000) end as created_at,
  make_timestamp(({PROSE_EPOCH} + n_chars) * 1000000) as imported_at,
  n_chars between 1000 and 1300 as is_favorite, n_chars < 100 as is_removed,
  case when n_chars > 6000 then 'inaccessible' else 'available' end as access_state,
  lang || ' ' || source as collection_key from documents""",
    "v_receipt": f"""
select {RECEIPT_ID} + o_orderkey as item_id,
  'Receipt #' || o_orderkey || chr(10) || 'Subtotal $' || cast(cast(o_totalprice as decimal(14,2)) as varchar)
  || chr(10) || 'Tax $' || cast(cast(tax as decimal(14,2)) as varchar) || chr(10)
  || 'Booking reference OD' || o_orderkey || chr(10) || o_orderpriority as ocr_text, o_orderdate as created_at
from orders join (select l_orderkey, sum(cast(l_extendedprice * l_tax as decimal(18,4))) as tax
                  from lineitem group by l_orderkey) t on l_orderkey = o_orderkey""",
    "v_chat": f"""
select {CHAT_ID} + conv_id as item_id,
  string_agg('04:' || lpad(cast(turn % 60 as varchar), 2, '0') || chr(10) || role || ': ' || text, chr(10)
             order by turn) as ocr_text,
  make_timestamp(({CHAT_EPOCH} + conv_id * 5400) * 1000000) as created_at from conversations group by conv_id""",
    "v_web": f"""
select {WEB_ID} + page_id as item_id,
  url || chr(10) || trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ ]+', ' ', 'g')) as ocr_text,
  make_timestamp(({WEB_EPOCH} + page_id * 3600) * 1000000) as created_at from pages""",
    "v_items": """
select item_id, 'prose' as pool_key, ocr_text, created_at from v_prose union all
select item_id, 'receipt', ocr_text, created_at from v_receipt union all
select item_id, 'chat', ocr_text, created_at from v_chat union all
select item_id, 'web', ocr_text, created_at from v_web""",
    "v_collection": f"""
select 0::bigint as collection_id, 'unassigned' as kind, 'Review' as title, false as is_archived, false as is_pinned,
  'ai' as created_by, make_timestamp({PROSE_EPOCH}::bigint * 1000000) as created_at
union all
select {_CELL}, case when source = 'src0' then 'userContext' else 'aiContext' end, lang || ' ' || source,
  source = 'src19', source = 'src1', case when source = 'src0' then 'user' else 'ai' end,
  make_timestamp(({PROSE_EPOCH} + cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) * 86400) * 1000000)
from (select distinct lang, source from documents) d
union all
select 1000000000 + item_id, 'aiContext', array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:4], ' '), false, false,
  'ai', make_timestamp(({PROSE_EPOCH} + item_id * 3600) * 1000000) from benchmark""",
    "v_cell": "select *, collection_id % 7 as sort_order from v_collection",
    "v_alias": """
select collection_id, array_to_string(list_reverse(string_split(title, ' ')), ' ') as alias_title,
  lower(array_to_string(list_reverse(string_split(title, ' ')), ' ')) as normalized_alias, created_at
from v_collection where kind <> 'unassigned'""",
    "v_dup": "select md5(text) as group_id, doc_id as item_id, doc_id as position from documents",
    "v_membership": f"""
select d.doc_id as item_id, {_CELL} as collection_id, case when toxic = 1 then 'user' else 'ai' end as source,
  round(0.7::double + least(n_chars, 20000) / 100000.0::double, 6) as confidence,
  make_timestamp(({PROSE_EPOCH} + n_chars) * 1000000) as created_at, d.doc_id as position
from documents d left join labels l on d.doc_id = l.doc_id where coalesce(quality, 1) = 1
union all
select d.doc_id, 0, 'user', null, make_timestamp(({PROSE_EPOCH} + n_chars) * 1000000), d.doc_id
from documents d join labels l on d.doc_id = l.doc_id where quality <> 1
union all
select d.doc_id, 2001 + {_LETTERS}, 'user', null, make_timestamp(({PROSE_EPOCH} + n_chars) * 1000000), d.doc_id
from documents d left join labels l on d.doc_id = l.doc_id
where coalesce(quality, 1) = 1 and n_chars between 2000 and 2400 and source <> 'src2'""",
    "v_run": """
select event_id as run_id, user_id as item_id, ts as started_at,
  case event_type when 'click' then 'reuse' when 'purchase' then 'create' when 'view' then 'needsReview' end as decision,
  case when event_type = 'error' then 'code_' || cast(floor(value) as bigint) end as error_code,
  case when value < 20 then 'ondevice-rules' else 'cloud-model' end as provider from events""",
    "v_eval": """
select doc_id as item_id, case when quality = 1 and toxic <> 1 then 'correct' when quality = 1 then 'wrongCollection'
  when toxic = 1 then 'shouldBeNeedsReview' else 'wrongCollectionName' end as label from labels""",
    "v_asset_list": VIEWS_SQL_LISTING,
    "v_listing": "select external_id, created_at, width, height from v_asset_list where is_screenshot",
    "v_stage": f"""
select event_id as item_id, case when user_id < 5 then null else 'asset-' || event_id end as external_id,
  case when value < 90 then 'photos' else 'fixture' end as source, ts as created_at, ts as updated_at,
  value > 60 as is_removed, case when value > 30 and value < 36 then 'inaccessible' else 'available' end as access_state,
  {_STATUS} as ocr_status, case when value < 10 then 1 else 2 end as ocr_version,
  case when event_type = 'error' then cast(floor(value / 10) as int) + 1 else 0 end as ocr_attempts,
  case when {_STATUS} = 'processing' then ts end as ocr_claimed_at,
  case when event_type = 'error' and value < 50 then ts + interval 1 hour end as ocr_next_retry_at,
  case when event_type = 'error' and value > 3 then 'code_' || cast(floor(value) as bigint) end as ocr_error,
  {_VISUAL} as visual_status, 1 as visual_version, case when {_VISUAL} = 'processing' then ts end as visual_claimed_at,
  case when {_VISUAL} = 'failed' then cast(floor(value / 20) as int) else 0 end as visual_attempts,
  {_ORGANIZE} as organize_status, user_id > 130 as organize_locked,
  case when {_ORGANIZE} = 'ready' then 2 when {_ORGANIZE} = 'failed' then 1 end as resolver_version,
  'fp-' || event_id as fingerprint from events""",
}


def views_sql(query: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``query`` with the common table expressions it names, dependencies first."""
    views = dict(VIEWS_SQL)
    views.update(extra or {})
    done: dict[str, str] = {}

    def add(text: str) -> None:
        for name in views:
            if name not in done and re.search(rf"\b{name}\b", text):
                done[name] = ""
                add(views[name])
                done.pop(name)
                done[name] = views[name]

    add(query)
    if not done:
        return query
    if query.lstrip().lower().startswith("with "):
        query = f"select * from ({query})"
    return "with " + ",\n".join(f"{name} as materialized ({body})" for name, body in done.items()) + "\n" + query
