"""Loading pages and keeping keyed tables current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import filters as fl
from shelfmark.operators import merge as mg
from shelfmark.operators.chunking import caption_chunks as captions_of
from shelfmark.operators.spread import explode_once
from shelfmark.plans import ingest
from shelfmark.plans.registered import query, table
from shelfmark.sources import pages as pg

NOW = "2024-06-01 00:00:00"


def landed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The ``pages`` table as the JSON a wiki would land: host = space, path = title."""
    raw = table(spark, folder, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda s: F.length(s) > 0)
    record = F.struct(
        F.col("page_id").cast("string").alias("id"),
        F.lit("page").alias("type"),
        path.alias("title"),
        F.struct(host.alias("key"), F.upper(host).alias("name")).alias("space"),
        F.struct(F.struct(F.col("html").alias("value")).alias("storage")).alias("body"),
        F.struct(
            F.length("html").alias("number"), F.lit("2024-01-01T00:00:00.000Z").alias("when"),
            F.struct(F.element_at(F.split(host, r"\."), -2).alias("displayName")).alias("by"),
        ).alias("version"),
        F.transform(steps, lambda s: F.struct(s.alias("id"), s.alias("title"))).alias("ancestors"),
        F.struct(
            F.struct(F.transform(F.split(host, r"\."), lambda s: F.struct(s.alias("name"))).alias("results")).alias("labels")
        ).alias("metadata"),
        F.struct(F.concat(F.lit("/wiki"), path).alias("webui")).alias("_links"),
        F.lit("ignored").alias("someUnknownField"),
    )
    return raw.select(F.to_json(record).alias("json"))


def wiki_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pg.page_metadata(pg.parse_pages(landed_pages(spark, folder), "json"), "https://wiki.example")


WIKI_SQL = """split_urls AS (
  SELECT page_id::VARCHAR AS page_id, html, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
         regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages),
wiki AS (
  SELECT page_id, path AS title, host AS space_key, upper(host) AS space_name, string_split(host, '.') AS labels,
         string_split(host, '.')[-2] AS author, length(html)::BIGINT AS version, 'https://wiki.example/wiki' || path AS url,
         list_filter(string_split(path, '/'), lambda s: s <> '') AS ancestors, html
  FROM split_urls)"""


@query(
    "src_pages",
    f"""WITH {WIKI_SQL}
SELECT page_id, space_key, title, length(html)::BIGINT AS n_chars FROM wiki""",
)
def src_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Landed JSON pages read with the fixed schema."""
    return wiki_pages(spark, folder).select("page_id", "space_key", "title", F.length("html").cast("long").alias("n_chars"))


@query(
    "page_metadata",
    f"""WITH {WIKI_SQL}
SELECT page_id, title, space_key, space_name, array_to_string(labels, ',') AS labels, author, version, url,
       array_to_string(ancestors, ' > ') AS ancestors, '2024-01-01T00:00:00.000Z' AS last_modified FROM wiki""",
)
def page_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return wiki_pages(spark, folder).select(
        "page_id", "title", "space_key", "space_name", F.array_join("labels", ",").alias("labels"), "author",
        F.col("version").cast("long").alias("version"), "url", F.array_join("ancestors", " > ").alias("ancestors"),
        "last_modified",
    )


@query(
    "chunk_metadata_json",
    f"""WITH {WIKI_SQL}
SELECT page_id, space_name, author, version, array_to_string(ancestors, '/') AS ancestors, len(ancestors)::BIGINT AS depth,
       true AS has_space_name FROM wiki""",
)
def chunk_metadata_json(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata folded into JSON with camelCase keys and read back."""
    columns = wiki_pages(spark, folder).select("page_id", "space_name", "author", "last_modified", "version", "ancestors")
    packed = pg.metadata_to_json(columns)
    named = packed.withColumn("has_space_name", F.get_json_object("metadata", "$.spaceName").isNotNull())
    back = pg.metadata_from_json(named)
    return back.select(
        "page_id", "space_name", "author", F.col("version").cast("long").alias("version"),
        F.array_join("ancestors", "/").alias("ancestors"), F.size("ancestors").cast("long").alias("depth"), "has_space_name",
    )


@query(
    "pages_modified_since",
    """SELECT o_orderkey AS page_id, o_orderpriority AS space_key, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS last_modified
FROM orders WHERE o_orderdate >= DATE '1998-06-15'""",
)
def pages_modified_since(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as pages: everything changed since the start of a day."""
    orders = table(spark, folder, "orders")
    pages = orders.select(
        F.col("o_orderkey").alias("page_id"), F.col("o_orderpriority").alias("space_key"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("last_modified"),
    )
    return pages.where(fl.modified_since(F.col("last_modified"), "1998-06-15T13:45:00"))


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages; toxic ones are drafts, good ones approved."""
    marks = table(spark, folder, "labels")
    joined = table(spark, folder, "documents").join(marks, "doc_id", "left")
    labels = F.array_compact(
        F.array(F.when(F.col("toxic") == 1, "draft"), F.when(F.col("quality") == 1, "approved"), F.col("lang"))
    )
    return joined.withColumn("labels", labels)


LABELLED_SQL = """labelled AS (
  SELECT d.*, list_filter([CASE WHEN toxic = 1 THEN 'draft' END, CASE WHEN quality = 1 THEN 'approved' END, lang],
                          lambda x: x IS NOT NULL) AS labels
  FROM documents d LEFT JOIN labels USING (doc_id))"""


@query(
    "label_filter",
    f"""WITH {LABELLED_SQL}
SELECT doc_id, source, array_to_string(labels, ',') AS labels FROM labelled
WHERE NOT list_has_any(labels, ['ignore', 'draft', 'archived']) AND list_has_any(labels, ['approved', 'de'])""",
)
def label_filter(spark: SparkSession, folder: str) -> DataFrame:
    keep = fl.keep_by_labels(F.col("labels"), include=["approved", "de"])
    return labelled_documents(spark, folder).where(keep).select("doc_id", "source", F.array_join("labels", ",").alias("labels"))


def lines_as_chunks(documents: DataFrame) -> DataFrame:
    """Every line of a document is a chunk."""
    lines = explode_once(documents, ["doc_id", "source"], F.split("text", "\n", -1), "place", "content")
    return lines.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("place").cast("string")).alias("chunk_id"),
        F.col("doc_id").alias("page_id"), F.col("source").alias("space_key"), "content",
    )


LINES_SQL = """chunk_lines AS (
  SELECT doc_id || '_' || (i - 1) AS chunk_id, doc_id AS page_id, source AS space_key, parts[i] AS content
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents), range(1, len(parts) + 1) AS r(i))"""


def _digest(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "page_id", "space_key", F.md5("content").alias("digest"))


@query(
    "upsert_chunks",
    f"""WITH {LINES_SQL},
updates AS (
  SELECT doc_id || '_0' AS chunk_id, doc_id AS page_id, 'reviewed' AS space_key, 'quality ' || quality AS content FROM labels
  UNION ALL SELECT 'item_' || item_id, -1 - item_id, 'items', text FROM benchmark)
SELECT chunk_id, page_id, space_key, md5(content) AS digest FROM (
  SELECT * FROM updates UNION ALL SELECT * FROM chunk_lines WHERE chunk_id NOT IN (SELECT chunk_id FROM updates))""",
)
def upsert_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """First lines are overwritten by reviews, benchmark items are new."""
    base = lines_as_chunks(table(spark, folder, "documents"))
    reviews = table(spark, folder, "labels").select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("chunk_id"), F.col("doc_id").alias("page_id"),
        F.lit("reviewed").alias("space_key"), F.concat(F.lit("quality "), F.col("quality")).alias("content"),
    )
    items = table(spark, folder, "benchmark").select(
        F.concat(F.lit("item_"), F.col("item_id")).alias("chunk_id"), (-1 - F.col("item_id")).alias("page_id"),
        F.lit("items").alias("space_key"), F.col("text").alias("content"),
    )
    return _digest(mg.upsert(base, reviews.unionByName(items), "chunk_id"))


@query(
    "replace_pages",
    f"""WITH {LINES_SQL},
fresh AS (
  SELECT doc_id || '_' || place AS chunk_id, doc_id AS page_id, source AS space_key, 'part ' || place AS content
  FROM labels JOIN documents USING (doc_id), range(0, 2) AS r(place) WHERE toxic = 0)
SELECT chunk_id, page_id, space_key, md5(content) AS digest FROM (
  SELECT * FROM fresh UNION ALL SELECT * FROM chunk_lines WHERE page_id NOT IN (SELECT doc_id FROM labels))""",
)
def replace_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled pages are replaced; toxic ones have no new chunks and end up empty."""
    documents = table(spark, folder, "documents")
    touched = table(spark, folder, "labels")
    places = F.explode(F.array(F.lit(0), F.lit(1))).alias("place")
    fresh = touched.where("toxic = 0").join(documents.select("doc_id", "source"), "doc_id").select("*", places)
    fresh = fresh.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("place").cast("string")).alias("chunk_id"),
        F.col("doc_id").alias("page_id"), F.col("source").alias("space_key"),
        F.concat(F.lit("part "), F.col("place")).alias("content"),
    )
    return _digest(mg.replace_pages(lines_as_chunks(documents), touched.select(F.col("doc_id").alias("page_id")), fresh))


@query(
    "delete_pages",
    f"""WITH {LINES_SQL}
SELECT chunk_id, page_id, space_key, md5(content) AS digest FROM chunk_lines
WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def delete_pages(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return _digest(mg.delete_pages(lines_as_chunks(table(spark, folder, "documents")), gone))


@query(
    "embed_join_check",
    """SELECT doc_id AS chunk_id, 'no vector' AS problem FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'no chunk' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""",
)
def embed_join_check(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and vectors that lack their partner."""
    chunks = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return mg.embedding_mismatches(chunks, vectors)


LATEST_ORDER_SQL = """latest AS (
  SELECT o_custkey, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS priority, max(o_orderdate) AS seen
  FROM orders GROUP BY o_custkey)"""


@query(
    "profile_upsert",
    f"""WITH {LATEST_ORDER_SQL}
SELECT c_name AS profile_name, coalesce(priority, c_mktsegment) AS chunker,
       CASE WHEN priority IS NULL THEN c_nationkey ELSE 64 END::BIGINT AS embedding_dimensions,
       TIMESTAMP '2020-01-01' AS created_at,
       CASE WHEN priority IS NULL THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '{NOW}' END AS updated_at
FROM customer LEFT JOIN latest ON o_custkey = c_custkey
UNION ALL
SELECT s_name, 'recursive', 64, TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' FROM supplier""",
)
def profile_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Registered profiles keep their creation time, new ones get the current one."""
    now = F.lit(NOW).cast("timestamp_ntz")
    born = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    registry = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("profile_name"), F.col("c_mktsegment").alias("chunker"),
        F.col("c_nationkey").cast("long").alias("embedding_dimensions"), born.alias("created_at"), born.alias("updated_at"),
    )
    newest = mg.latest_by_key(
        table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey"),
        "o_custkey", F.struct("o_orderdate", "o_orderkey"),
    )
    changed = registry.select("key", "profile_name").join(newest, F.col("key") == F.col("o_custkey")).select(
        "profile_name", F.col("o_orderpriority").alias("chunker"), F.lit(64).cast("long").alias("embedding_dimensions"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    added = table(spark, folder, "supplier").select(
        F.col("s_name").alias("profile_name"), F.lit("recursive").alias("chunker"),
        F.lit(64).cast("long").alias("embedding_dimensions"), now.alias("created_at"), now.alias("updated_at"),
    )
    return mg.upsert(registry.drop("key"), changed.unionByName(added), "profile_name", keep=("created_at",))


def profile_rows(spark: SparkSession, folder: str) -> DataFrame:
    name = (
        F.when(F.col("p_type") == "ECONOMY", F.col("p_name"))
        .when((F.col("p_size") > 40) & (F.col("p_type") == "PROMO"), "default")
        .when(F.col("p_type") == "LARGE", F.replace("p_name", F.lit(" "), F.lit("_")))
        .otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey")))
    )
    return table(spark, folder, "part").select("p_partkey", name.alias("name"))


@query(
    "profile_validate",
    """WITH rows_in AS (
  SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN p_name WHEN p_size > 40 AND p_type = 'PROMO' THEN 'default'
                         WHEN p_type = 'LARGE' THEN replace(p_name, ' ', '_')
                         ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS name FROM part)
SELECT p_partkey, name, CASE WHEN name = 'default' THEN 'reserved name'
  WHEN NOT regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') THEN 'invalid identifier'
  WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'duplicate name' END AS problem FROM rows_in""",
)
def profile_validate(spark: SparkSession, folder: str) -> DataFrame:
    return fl.check_profiles(profile_rows(spark, folder)).select("p_partkey", "name", "problem")


@query(
    "profile_complete",
    """SELECT c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'recursive' ELSE 'html_section' END AS chunker,
  CASE WHEN c_acctbal > 0 THEN 'remote' ELSE 'offline' END AS embedding_provider, 'hash-64' AS embedding_model,
  CASE WHEN c_nationkey > 10 THEN c_nationkey ELSE 64 END::BIGINT AS embedding_dimensions, 'chunks_' || c_name AS table_name
FROM customer""",
)
def profile_complete(spark: SparkSession, folder: str) -> DataFrame:
    """Missing settings come from the base configuration."""
    rows = table(spark, folder, "customer").select(
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "recursive").alias("chunker"),
        F.when(F.col("c_acctbal") > 0, "remote").alias("embedding_provider"),
        F.lit(None).cast("string").alias("embedding_model"),
        F.when(F.col("c_nationkey") > 10, F.col("c_nationkey").cast("long")).alias("embedding_dimensions"),
    )
    done = fl.complete_profiles(rows, "offline", "hash-64", 64)
    return done.withColumn("embedding_dimensions", F.col("embedding_dimensions").cast("long"))


@query(
    "profile_resolve",
    """SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN 'chunks_' || c_name ELSE 'chunks' END AS table_name,
  CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'offline' END AS embedding_provider,
  CASE WHEN c_acctbal > 0 THEN c_nationkey ELSE 64 END::BIGINT AS embedding_dimensions, NULL::VARCHAR AS error
FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def profile_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Each order asks for its customer's profile; only solvent customers are registered."""
    people = table(spark, folder, "customer")
    registry = people.where("c_acctbal > 0").select(
        F.col("c_name").alias("profile_name"), F.concat(F.lit("chunks_"), "c_name").alias("table_name"),
        F.col("c_mktsegment").alias("embedding_provider"), F.lit("m").alias("embedding_model"),
        F.col("c_nationkey").cast("long").alias("embedding_dimensions"),
    )
    asked = table(spark, folder, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    names = asked.select("o_orderkey", F.col("c_name").alias("name"))
    spare = {"table_name": "chunks", "embedding_provider": "offline", "embedding_model": "hash", "embedding_dimensions": 64}
    found = fl.resolve_profiles(names, registry, spare)
    return found.select(
        "o_orderkey", "table_name", "embedding_provider", F.col("embedding_dimensions").cast("long").alias("embedding_dimensions"), "error"
    )


@query(
    "profile_missing",
    """SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN 'chunks_' || c_name END AS table_name,
  CASE WHEN c_acctbal > 0 THEN NULL ELSE 'profile not found and no fallback configured' END AS error
FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def profile_missing(spark: SparkSession, folder: str) -> DataFrame:
    """The same without a usable fallback: unknown profiles are errors."""
    people = table(spark, folder, "customer")
    registry = people.where("c_acctbal > 0").select(
        F.col("c_name").alias("profile_name"), F.concat(F.lit("chunks_"), "c_name").alias("table_name"), F.lit("p").alias("embedding_provider"),
        F.lit("m").alias("embedding_model"), F.lit(64).alias("embedding_dimensions"),
    )
    names = table(spark, folder, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("name"))
    return fl.resolve_profiles(names, registry, {"table_name": "chunks", "embedding_provider": "offline"}).select("o_orderkey", "table_name", "error")


def ticket_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as cached tickets."""
    return table(spark, folder, "customer").select(
        F.concat(F.lit("T-"), F.col("c_custkey")).alias("ticket_key"), F.col("c_mktsegment").alias("project_key"),
        F.col("c_name").alias("question_text"), F.lit("old").alias("resolution_text"), F.lit("import").alias("source"),
        F.col("c_nationkey").cast("long").alias("hit_count"),
        F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("last_hit_at"),
    )


@query(
    "cache_upsert",
    f"""WITH {LATEST_ORDER_SQL}, fresh AS (
  SELECT 'T-' || s_suppkey || '-S' AS ticket_key, 'SUPPLY' AS project_key, s_name AS question_text, 'new' AS resolution_text,
         'agent' AS source, 0::BIGINT AS hit_count, NULL::TIMESTAMP AS last_hit_at FROM supplier)
SELECT 'T-' || c_custkey AS ticket_key, CASE WHEN priority IS NULL THEN c_mktsegment ELSE 'ORDERS' END AS project_key,
       coalesce(priority, c_name) AS question_text, CASE WHEN priority IS NULL THEN 'old' ELSE 'new' END AS resolution_text,
       'import' AS source, c_nationkey::BIGINT AS hit_count, TIMESTAMP '2020-01-01' AS last_hit_at
FROM customer LEFT JOIN latest ON o_custkey = c_custkey UNION ALL SELECT * FROM fresh""",
)
def cache_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """New resolutions overwrite texts but keep source, hit count and last hit."""
    newest = mg.latest_by_key(
        table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey"),
        "o_custkey", F.struct("o_orderdate", "o_orderkey"),
    )
    changed = newest.select(
        F.concat(F.lit("T-"), F.col("o_custkey")).alias("ticket_key"), F.lit("ORDERS").alias("project_key"),
        F.col("o_orderpriority").alias("question_text"), F.lit("new").alias("resolution_text"),
    )
    added = table(spark, folder, "supplier").select(
        F.concat(F.lit("T-"), F.col("s_suppkey"), F.lit("-S")).alias("ticket_key"), F.lit("SUPPLY").alias("project_key"),
        F.col("s_name").alias("question_text"), F.lit("new").alias("resolution_text"),
    )
    defaults = {
        "source": F.lit("agent"), "hit_count": F.lit(0).cast("long"), "last_hit_at": F.lit(None).cast("timestamp_ntz"),
    }
    return mg.upsert(ticket_cache(spark, folder), changed.unionByName(added), "ticket_key", defaults=defaults)


@query(
    "cache_record_hits",
    """WITH hits AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS hit_at FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT 'T-' || c_custkey AS ticket_key, (c_nationkey + coalesce(n, 0))::BIGINT AS hit_count,
       coalesce(hit_at, TIMESTAMP '2020-01-01') AS last_hit_at FROM customer LEFT JOIN hits ON o_custkey = c_custkey""",
)
def cache_record_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Finished orders count as reuses of their customer's cached ticket."""
    hits = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("T-"), F.col("o_custkey")).alias("ticket_key"), F.col("o_orderdate").cast("timestamp_ntz").alias("hit_at")
    )
    return mg.record_hits(ticket_cache(spark, folder), hits).select("ticket_key", "hit_count", "last_hit_at")


@query(
    "stale_pages",
    f"""WITH {WIKI_SQL}, stored AS (
  SELECT space_key, page_id FROM wiki UNION ALL SELECT space_key, 'local_' || page_id FROM wiki),
live AS (SELECT space_key, page_id FROM wiki WHERE list_contains(labels, 'www') OR version < 3000),
spaces AS (SELECT DISTINCT space_key FROM wiki WHERE NOT list_contains(labels, 'blog'))
SELECT s.space_key, s.page_id FROM stored s
WHERE NOT starts_with(page_id, 'local_') AND space_key IN (SELECT space_key FROM spaces)
  AND space_key IN (SELECT space_key FROM live) AND (space_key, page_id) NOT IN (SELECT space_key, page_id FROM live)""",
)
def stale_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Long pages vanished, except on www hosts; blogs are not configured; local pages stay."""
    pages = wiki_pages(spark, folder)
    stored = pages.select("space_key", "page_id")
    local = pages.select("space_key", F.concat(F.lit("local_"), "page_id").alias("page_id"))
    live = pages.where(F.array_contains("labels", "www") | (F.col("version") < 3000)).select("space_key", "page_id")
    spaces = pages.where(~F.array_contains("labels", "blog")).select("space_key").distinct()
    return mg.stale_pages(stored.unionByName(local), live, spaces)


SYNC_SQL = f"""{LABELLED_SQL},
stored AS (SELECT o_custkey AS page_id, 'p' || o_custkey || '_' || o_orderkey AS chunk_id, 'old' AS digest FROM orders),
versions AS (SELECT doc_id AS page_id, text, labels FROM labelled)"""


@query(
    "sync_batch",
    f"""WITH {SYNC_SQL}
SELECT page_id, chunk_id, digest FROM stored WHERE page_id NOT IN (SELECT page_id FROM versions)
UNION ALL SELECT page_id, page_id || '_' || (i - 1), md5(parts[i]) FROM (
  SELECT page_id, string_split(text, chr(10)) AS parts FROM versions WHERE NOT list_has_any(labels, ['ignore', 'draft', 'archived'])),
  range(1, len(parts) + 1) AS r(i)""",
)
def sync_batch(spark: SparkSession, folder: str) -> DataFrame:
    """One sync: newest page versions, excluded pages cleared, the others replaced."""
    stored = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("page_id"),
        F.concat(F.lit("p"), F.col("o_custkey"), F.lit("_"), F.col("o_orderkey")).alias("chunk_id"), F.lit("old").alias("digest"),
    )
    documents = labelled_documents(spark, folder).select(F.col("doc_id").alias("page_id"), "text", "labels")
    outdated = documents.withColumn("text", F.lit("outdated")).withColumn("version", F.lit(1))
    current = documents.withColumn("version", F.lit(2))
    versions = outdated.unionByName(current).withColumn("last_modified", F.lit("2024-01-01"))
    newest = ingest.newest_versions(versions)
    kept = ingest.kept_pages(newest, ingest.Profile())
    parts = explode_once(kept, ["page_id"], F.split("text", "\n", -1), "place", "line")
    fresh = parts.select(
        "page_id", F.concat_ws("_", F.col("page_id").cast("string"), F.col("place").cast("string")).alias("chunk_id"),
        F.md5("line").alias("digest"),
    )
    return mg.replace_pages(stored, newest, fresh)


@query(
    "ingest_counters",
    f"""WITH {LABELLED_SQL}, seen AS (
  SELECT CASE WHEN list_has_any(labels, ['ignore', 'draft', 'archived']) THEN 'skipped'
              WHEN len(string_split(text, chr(10))) < 2 THEN 'failed' ELSE 'processed' END AS status,
         len(string_split(text, chr(10))) AS n FROM labelled)
SELECT status, count(*)::BIGINT AS n_pages, sum(CASE WHEN status = 'processed' THEN n ELSE 0 END)::BIGINT AS n_chunks
FROM seen GROUP BY status""",
)
def ingest_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and chunks of a run by status; one-line documents count as failures."""
    documents = labelled_documents(spark, folder)
    n = F.size(F.split("text", "\n", -1))
    error = F.when(n < 2, F.lit("too short"))
    status = ingest.page_status(fl.keep_by_labels(F.col("labels")), n, F.when(fl.keep_by_labels(F.col("labels")), error))
    rows = documents.select(status.alias("status"), n.alias("n"))
    counted = rows.select("status", F.when(F.col("status") == "processed", F.col("n")).otherwise(0).alias("n_chunks"))
    return ingest.run_counters(counted)


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as attachments: the language stands for the media type."""
    kinds = F.create_map(*[F.lit(x) for x in ("de", "image/png", "en", "image/jpeg", "es", "application/pdf", "fr", "image/gif")])
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("attachment_id"), F.col("doc_id").alias("page_id"),
        F.concat(F.col("source"), F.lit(".img")).alias("filename"), kinds[F.col("lang")].alias("media_type"),
        F.col("n_chars").alias("file_size"), F.encode("text", "UTF-8").alias("data"),
        F.regexp_extract("text", r"\A([^.]*\.)", 1).alias("caption"),
    )


ATTACHMENTS_SQL = """attachments AS (
  SELECT doc_id, source || '.img' AS filename, n_chars AS file_size, strlen(text) AS n_bytes, text,
         CASE lang WHEN 'de' THEN 'image/png' WHEN 'en' THEN 'image/jpeg' WHEN 'es' THEN 'application/pdf' ELSE 'image/gif' END AS media_type
  FROM documents)"""


@query(
    "attachments_eligible",
    f"""WITH {ATTACHMENTS_SQL}
SELECT doc_id AS attachment_id, media_type, file_size, n_bytes::BIGINT AS n_bytes FROM attachments
WHERE media_type LIKE 'image/%' AND file_size <= 2000 AND n_bytes <= 2000""",
)
def attachments_eligible(spark: SparkSession, folder: str) -> DataFrame:
    """Images whose stated and real sizes stay below the cap."""
    sized = attachments(spark, folder).withColumn("n_bytes", F.octet_length("data").cast("long"))
    keep = fl.eligible_attachment(F.col("media_type"), F.col("file_size"), F.col("n_bytes"), 2000)
    return sized.where(keep).select("attachment_id", "media_type", "file_size", "n_bytes")


@query(
    "caption_chunks",
    f"""WITH {WIKI_SQL}, {ATTACHMENTS_SQL},
captioned AS (SELECT *, regexp_extract(text, '\\A([^.]*\\.)', 1) AS caption FROM attachments)
SELECT page_id || '_att_' || doc_id AS chunk_id, page_id, doc_id AS attachment_id, 'image' AS content_type,
       'Page: ' || title || chr(10) || 'Image: ' || filename || chr(10) || chr(10) || caption AS content
FROM wiki JOIN captioned ON doc_id::VARCHAR = page_id WHERE length(caption) > 0""",
)
def caption_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A chunk for each image of a page; the first sentence stands for the caption."""
    images = attachments(spark, folder).withColumn("page_id", F.col("page_id").cast("string"))
    rows = captions_of(wiki_pages(spark, folder), images)
    return rows.select("chunk_id", "page_id", "attachment_id", "content_type", "content")
