"""Text functions and chunking over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import chunking as ch
from shelfmark.operators import golden as gd
from shelfmark.operators.spread import explode_once, spread
from shelfmark.plans.registered import query, table
from shelfmark.plans.registered.answers import GERMAN_SQL, TRIM
from shelfmark.sources.files import file_pages

WINDOW, OVERLAP = 120, 20
STEP = WINDOW - OVERLAP


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    return table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("page_id"), path.alias("title"),
        F.filter(F.split(path, "/"), lambda s: F.length(s) > 0).alias("ancestors"), "html",
    )


def digest(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, F.length(column).cast("long").alias("n_chars"), F.md5(column).alias("digest"))


# The fixture's markup is simple enough for SQL: an opened bold paragraph ends
# at the next paragraph, and there are no tables or code blocks.
PAGE_TEXT_SQL = r"""bodies AS (
  SELECT page_id::VARCHAR AS page_id, url, regexp_replace(regexp_extract(html, '<body>(.*?)(</body>|\z)', 1, 's'), '<!--.*?-->', '', 'gs') AS body
  FROM pages),
tight AS (SELECT page_id, url, regexp_replace(body, '\s*(<[^>]+>)\s*', '\1', 'g') AS body FROM bodies),
marked AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(replace(
    body, '<br><p>', chr(10) || chr(10) || chr(10) || '<p>'), '<br></article>', chr(10) || chr(10) || chr(10)),
    '<li>', '• '), '</li>', chr(10)), '<h1>', chr(10) || '# '), '</h1>', chr(10) || chr(10)), '</p>', chr(10) || chr(10)) AS body
  FROM tight),
blocks AS (SELECT page_id, url, replace(body, '</div>', chr(10) || chr(10)) AS body FROM marked),
plain AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]+>', '', 'g'),
    '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS text
  FROM blocks)"""


@query(
    "html_to_text",
    f"WITH {PAGE_TEXT_SQL} SELECT page_id, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM plain",
)
def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return digest(ch.html_to_text(pages(spark, folder)), "page_id", "text")


@query(
    "html_sections",
    f"""WITH {PAGE_TEXT_SQL},
cut AS (
  SELECT page_id, regexp_extract(text, '(?s)\\A(.*?)\\n# ([^\\n]*)\\n\\n(.*)\\z', ['before', 'title', 'after']) AS p FROM plain)
SELECT page_id, 0::BIGINT AS place, '' AS path, length(trim(p.before, {TRIM}))::BIGINT AS n_chars, md5(trim(p.before, {TRIM})) AS digest
FROM cut WHERE trim(p.before, {TRIM}) <> ''
UNION ALL SELECT page_id, 1, p.title, length(trim(p.after, {TRIM})), md5(trim(p.after, {TRIM})) FROM cut""",
)
def html_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Parts between headings, with the article wrapper opened."""
    parts = ch.html_sections(pages(spark, folder).select("page_id", "html"), {"descend": ("article",)})
    return parts.select(
        "page_id", F.col("chunk_index").alias("place"), F.array_join("header_path", " > ").alias("path"),
        F.length(tx.strip(F.col("content"))).cast("long").alias("n_chars"), F.md5(tx.strip(F.col("content"))).alias("digest"),
    )


NESTED_TABLE = "'| id | n |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || n_chars || ' |'"


@query(
    "html_nested",
    f"""SELECT doc_id::VARCHAR AS page_id, source AS path, 'text' AS kind, md5(trim(text, {TRIM})) AS digest FROM documents WHERE trim(text, {TRIM}) <> ''
UNION ALL SELECT doc_id::VARCHAR, source || ' > ' || lang, 'table', md5({NESTED_TABLE}) FROM documents
UNION ALL SELECT doc_id::VARCHAR, source || ' > ' || lang || ' > deep', 'code', md5('```' || chr(10) || 'x = 1' || chr(10) || '```') FROM documents
UNION ALL SELECT doc_id::VARCHAR, source || ' > second', 'text', md5('• ' || lang || chr(10) || '• last') FROM documents""",
)
def html_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts below nested headings, with a table, a code block and a list: paths, kinds and the text itself."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit("<h1>"), "source", F.lit("</h1><p>"), escaped, F.lit("</p><h2>"), "lang", F.lit("</h2><table><tr><th>id<th>n</tr><tr><td>"),
        F.col("doc_id").cast("string"), F.lit("<td>"), F.col("n_chars").cast("string"), F.lit("</table><h3>deep</h3><pre>x = 1</pre><h2>second</h2><ul><li>"),
        "lang", F.lit("<li>last</ul>"),
    )
    parts = ch.html_sections(documents(spark, folder).select(F.col("doc_id").cast("string").alias("page_id"), page.alias("html")))
    return parts.select("page_id", F.array_join("header_path", " > ").alias("path"), F.col("content_type").alias("kind"), F.md5(tx.strip(F.col("content"))).alias("digest"))


def _words_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\S+'))"


TAIL_SQL = f"""CASE WHEN length(current) <= {4 * OVERLAP} THEN current
  WHEN regexp_matches(right(current, {4 * OVERLAP}), '\\A[^.!?]*[.!?]\\s*') THEN regexp_replace(right(current, {4 * OVERLAP}), '\\A[^.!?]*[.!?]\\s*', '')
  WHEN regexp_matches(right(current, {4 * OVERLAP}), '\\A\\S*\\s+') THEN regexp_replace(right(current, {4 * OVERLAP}), '\\A\\S*\\s+', '')
  ELSE right(current, {4 * OVERLAP}) END"""


@query(
    "chunk_html_section",
    f"""WITH RECURSIVE {PAGE_TEXT_SQL},
split_pages AS (
  SELECT page_id, url, text, regexp_split_to_array(text, '\\n\\n+') AS parts, {_words_sql('text')} <= {WINDOW} AS whole FROM plain
  WHERE trim(text, {TRIM}) <> ''),
walk AS (
  SELECT page_id, 0 AS i, ''::VARCHAR AS current, 0::BIGINT AS used, NULL::VARCHAR AS done FROM split_pages WHERE NOT whole
  UNION ALL
  SELECT page_id, i + 1, CASE WHEN full_now THEN {TAIL_SQL} ELSE current END || part || chr(10) || chr(10),
         CASE WHEN full_now THEN {_words_sql(f"({TAIL_SQL}) || part")} ELSE used + cost END::BIGINT,
         CASE WHEN full_now THEN trim(current, {TRIM}) END
  FROM (SELECT w.*, s.parts[i + 1] AS part, {_words_sql('s.parts[i + 1]')} AS cost,
               used + {_words_sql('s.parts[i + 1]')} > {WINDOW} AND current <> '' AS full_now
        FROM walk w JOIN split_pages s USING (page_id) WHERE i < len(s.parts))),
pieces AS (
  SELECT page_id, i, done AS content FROM walk WHERE done IS NOT NULL
  UNION ALL SELECT w.page_id, i + 1, trim(current, {TRIM}) FROM walk w JOIN split_pages s ON s.page_id = w.page_id AND i = len(s.parts)
            WHERE trim(current, {TRIM}) <> ''
  UNION ALL SELECT page_id, 0, trim(text, {TRIM}) FROM split_pages WHERE whole),
numbered AS (
  SELECT p.*, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place, count(*) OVER (PARTITION BY page_id) AS total,
         regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path
  FROM pieces p JOIN split_pages USING (page_id)),
prefixed AS (
  SELECT *, 'Page: ' || path || chr(10) || 'Path: ' || array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), ' > ')
    || chr(10) || chr(10) || content AS chunk FROM numbered)
SELECT page_id || '_' || place AS chunk_id, page_id, place AS chunk_index, total AS total_chunks, 'text' AS content_type, '' AS path,
       length(chunk)::BIGINT AS n_chars, md5(chunk) AS digest FROM prefixed""",
)
def chunk_html_section(spark: SparkSession, folder: str) -> DataFrame:
    """The default strategy; packing carries overlap from piece to piece."""
    chunks = ch.chunk_pages(pages(spark, folder), "html_section", {"max_tokens": WINDOW, "overlap_tokens": OVERLAP})
    return chunks.select(
        "chunk_id", "page_id", "chunk_index", "total_chunks", "content_type", F.array_join("header_path", " > ").alias("path"),
        F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest"),
    )


@query("chunk_recursive")
def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    chunks = ch.chunk_pages(pages(spark, folder), "recursive", {"chunk_size": 600, "chunk_overlap": 80})
    return chunks.select(
        "chunk_id", "page_id", "chunk_index", "total_chunks", F.length("content").cast("long").alias("n_chars"),
        F.md5("content").alias("digest"),
    )


WINDOWS_SQL = f"""tokens AS (SELECT doc_id, source, lang, regexp_extract_all(text, '\\S+\\s*') AS t FROM documents),
windows AS (
  SELECT doc_id, source, lang, i AS place, greatest(ceil((len(t) - {WINDOW}) / {STEP}), 0)::BIGINT + 1 AS total,
         trim(array_to_string(t[i * {STEP} + 1 : i * {STEP} + {WINDOW}], ''), {TRIM}) AS content
  FROM tokens, range(0, greatest(ceil((len(t) - {WINDOW}) / {STEP}), 0)::BIGINT + 1) AS r(i) WHERE len(t) > 0)"""


@query(
    "chunk_fixed",
    f"""WITH {WINDOWS_SQL}
SELECT doc_id || '_' || place AS chunk_id, doc_id, place::BIGINT AS chunk_index, total AS total_chunks, md5(content) AS digest
FROM windows""",
)
def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping word windows of every document, in the JVM."""
    texts = spread(documents(spark, folder).select(F.col("doc_id").alias("page_id"), "text"))
    windows = texts.select("page_id", ch.token_windows(F.col("text"), WINDOW, OVERLAP).alias("windows"))
    cut = ch.pieces_of_array(windows, "windows")
    return cut.select(
        F.concat_ws("_", F.col("page_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("page_id").alias("doc_id"), "chunk_index", "total_chunks", F.md5("content").alias("digest"),
    )


@query(
    "chunk_fixed_pages",
    f"""WITH {PAGE_TEXT_SQL},
tokens AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path, regexp_extract_all(trim(text, {TRIM}), '\\S+\\s*') AS t FROM plain)
SELECT page_id || '_' || i AS chunk_id, i::BIGINT AS chunk_index, greatest(ceil((len(t) - {WINDOW}) / {STEP}), 0)::BIGINT + 1 AS total_chunks,
       md5('Page: ' || path || chr(10) || 'Path: ' ||
           array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), ' > ') || chr(10) || chr(10) ||
           trim(array_to_string(t[i * {STEP} + 1 : i * {STEP} + {WINDOW}], ''), {TRIM})) AS digest
FROM tokens, range(0, greatest(ceil((len(t) - {WINDOW}) / {STEP}), 0)::BIGINT + 1) AS r(i)""",
)
def chunk_fixed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed-size strategy on HTML pages, with prefix and numbering."""
    chunks = ch.chunk_pages(pages(spark, folder), "fixed_size", {"max_tokens": WINDOW, "overlap_tokens": OVERLAP})
    return chunks.select("chunk_id", "chunk_index", "total_chunks", F.md5("content").alias("digest"))


@query(
    "chunk_numbering",
    """SELECT doc_id || '_' || (i - 1) AS chunk_id, (i - 1)::BIGINT AS chunk_index, len(parts)::BIGINT AS total_chunks
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), range(1, len(parts) + 1) AS r(i)""",
)
def chunk_numbering(spark: SparkSession, folder: str) -> DataFrame:
    """Index, total and id of each line of a document."""
    rows = documents(spark, folder).select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.array("lang").alias("ancestors"),
        F.split("text", "\n", -1).alias("parts"),
    )
    return ch.chunks_of(ch.pieces_of_array(rows, "parts")).select("chunk_id", "chunk_index", "total_chunks")


@query(
    "chunk_prefix",
    """SELECT doc_id, 'Page: ' || source || CASE WHEN lang <> 'en' THEN chr(10) || 'Path: ' || lang || ' > ' || source ELSE '' END
  || CASE WHEN n_chars > 1000 THEN chr(10) || 'Section: ' || lang ELSE '' END || chr(10) || chr(10) AS prefix FROM documents""",
)
def chunk_prefix(spark: SparkSession, folder: str) -> DataFrame:
    none = F.array().cast("array<string>")
    ancestors = F.when(F.col("lang") != "en", F.array("lang", "source")).otherwise(none)
    path = F.when(F.col("n_chars") > 1000, F.array("lang")).otherwise(none)
    return documents(spark, folder).select("doc_id", tx.context_prefix(F.col("source"), ancestors, path).alias("prefix"))


@query(
    "overlap_tail",
    """WITH tails AS (SELECT doc_id, length(text) <= 160 AS whole, CASE WHEN length(text) <= 160 THEN text ELSE right(text, 160) END AS t FROM documents)
SELECT doc_id, CASE WHEN whole THEN t
  WHEN regexp_matches(t, '\\A[^.!?]*[.!?]\\s*') THEN regexp_replace(t, '\\A[^.!?]*[.!?]\\s*', '')
  WHEN regexp_matches(t, '\\A\\S*\\s+') THEN regexp_replace(t, '\\A\\S*\\s+', '') ELSE t END AS tail FROM tails""",
)
def overlap_tail(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", tx.overlap_tail(F.col("text"), 40).alias("tail"))


MARKDOWN_SQL = """md AS (
  SELECT doc_id, '# ' || source || ' & more' || chr(10) || text || chr(10) || '```sql' || chr(10) || 'a < ' || lang || chr(10) || chr(10)
    || 'b > c' || chr(10) || CASE WHEN lang = 'fr' THEN '' ELSE '```' || chr(10) || '###### end ' || lang END AS body,
    source, lang, text FROM documents)"""
ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Each document between a heading and a code block; French ones leave it open."""
    close = F.when(F.col("lang") == "fr", "").otherwise(F.concat(F.lit("```\n###### end "), F.col("lang")))
    body = F.concat(F.lit("# "), "source", F.lit(" & more\n"), "text", F.lit("\n```sql\na < "), "lang", F.lit("\n\nb > c\n"), close)
    return documents(spark, folder).select("doc_id", body.alias("body"))


@query(
    "md_to_html",
    f"""WITH {MARKDOWN_SQL},
lines AS (
  SELECT doc_id, string_agg(CASE WHEN regexp_matches(p, '\\A#{{1,6}}\\s+.+')
      THEN '<h' || length(regexp_extract(p, '\\A(#+)', 1)) || '>' || {ESCAPED.format("regexp_extract(p, '\\A#+\\s+(.+)', 1)")}
           || '</h' || length(regexp_extract(p, '\\A(#+)', 1)) || '>'
      ELSE '<p>' || {ESCAPED.format('p')} || '</p>' END, chr(10) ORDER BY i) FILTER (trim(p, {TRIM}) <> '') AS html
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM md), range(1, len(parts) + 1) AS r(i), (SELECT parts[i] AS p) GROUP BY doc_id),
pieces AS (
  SELECT doc_id, concat_ws(chr(10), '<h1>' || source || ' &amp; more</h1>', html,
    '<pre><code>a &lt; ' || lang || chr(10) || chr(10) || 'b &gt; c' || CASE WHEN lang = 'fr' THEN chr(10) ELSE '' END || '</code></pre>',
    CASE WHEN lang <> 'fr' THEN '<h6>end ' || lang || '</h6>' END) AS html
  FROM md JOIN lines USING (doc_id))
SELECT doc_id, length(html)::BIGINT AS n_chars, md5(html) AS digest FROM pieces""",
)
def md_to_html(spark: SparkSession, folder: str) -> DataFrame:
    return digest(markdown(spark, folder).select("doc_id", tx.markdown_to_html(F.col("body")).alias("html")), "doc_id", "html")


@query(
    "text_to_html",
    f"""WITH blocks AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10) || chr(10)), '\\n\\n+'),
                                            lambda b: trim(b, {TRIM})), lambda b: b <> '') AS b FROM documents),
joined AS (SELECT doc_id, array_to_string(list_transform(b, lambda x: '<p>' || {ESCAPED.format('x')} || '</p>'), chr(10)) AS html FROM blocks)
SELECT doc_id, length(html)::BIGINT AS n_chars, md5(html) AS digest FROM joined""",
)
def text_to_html(spark: SparkSession, folder: str) -> DataFrame:
    """Lines set apart by blank lines become paragraphs."""
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n\n"))
    return digest(documents(spark, folder).select("doc_id", tx.text_to_html(spaced).alias("html")), "doc_id", "html")


@query(
    "local_file_pages",
    f"""WITH files AS (SELECT doc_id, text, source || '/' || doc_id || CASE lang WHEN 'fr' THEN '.html' ELSE '.txt' END AS path FROM documents),
blocks AS (
  SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\\n\\n+'), lambda b: trim(b, {TRIM})), lambda b: b <> '') AS b FROM files),
made AS (
  SELECT *, CASE WHEN path LIKE '%.html' THEN text
            ELSE array_to_string(list_transform(b, lambda x: '<p>' || {ESCAPED.format('x')} || '</p>'), chr(10)) END AS html FROM blocks)
SELECT 'local_' || left(md5(path), 12) AS page_id, doc_id::VARCHAR AS title, 'local' AS space_key, path AS url, 1 AS version,
       '2024-06-01T00:00:00Z' AS last_modified, md5(html) AS digest FROM made""",
)
def local_file_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a local text or HTML file, converted to a page."""
    extension = F.when(F.col("lang") == "fr", ".html").otherwise(".txt")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), extension)
    files = documents(spark, folder).select(
        path.alias("file_path"), path.alias("relative_path"), F.col("doc_id").cast("string").alias("file_name"), extension.alias("extension"),
        F.lit("2024-06-01 00:00:00").cast("timestamp").alias("modified_at"), F.encode("text", "UTF-8").alias("content"),
    )
    return file_pages(files).select(
        "page_id", "title", "space_key", "url", "version", "last_modified", F.md5("html").alias("digest"),
    )


@query(
    "local_file_ids",
    """SELECT doc_id, 'local_' || left(md5(source || '/' || lang || '/' || doc_id || '.md'), 12) AS page_id,
       source || ' > ' || lang AS ancestors FROM documents""",
)
def local_file_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return documents(spark, folder).select(
        "doc_id", tx.local_page_id(path).alias("page_id"), F.array_join(tx.path_ancestors(path), " > ").alias("ancestors")
    )


@query(
    "token_counts",
    """SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_words, ceil(length(text) / 4.0)::BIGINT AS n_estimate FROM documents""",
)
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", tx.count_tokens(F.col("text")).alias("n_words"), tx.count_tokens(F.col("text"), "chars4").alias("n_estimate")
    )


@query(
    "lang_heuristic",
    f"""SELECT lang, CASE WHEN {GERMAN_SQL.format('text')} THEN 'de' ELSE 'en' END AS guess, count(*)::BIGINT AS n
FROM documents GROUP BY ALL""",
)
def lang_heuristic(spark: SparkSession, folder: str) -> DataFrame:
    """How the German test does on each known language."""
    guessed = documents(spark, folder).select("lang", tx.language_of(F.col("text")).alias("guess"))
    return guessed.groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalize_question",
    f"""WITH q AS (
  SELECT doc_id, left(trim(regexp_replace(source || '  ' || chr(9) || ' help' || chr(10) || chr(10) || text, '[ \\t]+', ' ', 'g'), {TRIM}), 8000) AS question
  FROM documents) SELECT doc_id, length(question)::BIGINT AS n_chars, md5(question) AS digest FROM q""",
)
def normalize_question(spark: SparkSession, folder: str) -> DataFrame:
    """Summary and description as one question; the length limit is part of the rule."""
    summary = F.concat("source", F.lit("  \t help"))
    asked = documents(spark, folder).select("doc_id", tx.normalize_question(summary, F.col("text")).alias("question"))
    return digest(asked, "doc_id", "question")


# -- golden sets over document lines ------------------------------------------


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines as chunks with JSON metadata, some of it unusable."""
    rows = explode_once(documents(spark, folder), ["doc_id", "source", "lang"], F.split("text", "\n", -1), "place", "content")
    total = (
        F.when(F.col("lang") == "es", F.lit('"many"')).when(F.col("lang") == "fr", F.lit("2.5")).otherwise(F.lit("9"))
    )
    metadata = F.concat(
        F.lit('{"chunkIndex": '), F.col("place").cast("string"), F.lit(', "totalChunks": '), total,
        F.lit(', "headerPath": ["'), F.col("source"), F.lit('", 7, "'), F.col("lang"), F.lit('"], "spaceName": '),
        F.when(F.col("lang") == "de", F.lit("null")).otherwise(F.lit('"Docs"')), F.lit("}"),
    )
    return rows.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("place").cast("string")).alias("chunk_id"),
        F.col("doc_id").alias("page_id"), F.when(F.col("lang") != "de", F.col("source")).alias("title"),
        F.col("source").alias("space_key"), "content", metadata.alias("metadata"),
    )


LINES_SQL = """lines AS (
  SELECT doc_id || '_' || (i - 1) AS chunk_id, doc_id AS page_id, CASE WHEN lang <> 'de' THEN source ELSE '' END AS title, source AS space_key,
         parts[i] AS content, i - 1 AS chunk_index, lang
  FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents), range(1, len(parts) + 1) AS r(i)
  WHERE lang NOT IN ('es', 'fr'))"""


@query(
    "valid_chunks",
    f"""WITH {LINES_SQL}
SELECT chunk_id, title, space_key, chunk_index::BIGINT AS chunk_index, 9::BIGINT AS total_chunks, space_key || ' > ' || lang AS header_path,
       CASE WHEN lang <> 'de' THEN 'Docs' END AS space_name FROM lines""",
)
def valid_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with usable metadata; text or fractions instead of a total are not."""
    good = gd.valid_chunks(lines(spark, folder))
    return good.select(
        "chunk_id", "title", "space_key", "chunk_index", "total_chunks", F.array_join("header_path", " > ").alias("header_path"),
        "space_name",
    )


SAMPLE = 60
SAMPLE_SQL = f"""{LINES_SQL},
sample AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || chunk_id), chunk_id) - 1 AS place FROM lines
  ORDER BY md5('42:' || chunk_id), chunk_id LIMIT {SAMPLE})"""


@query("sample_chunks", f"WITH {SAMPLE_SQL} SELECT chunk_id, page_id, place FROM sample")
def sample_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded sample of valid chunks."""
    return gd.sample_chunks(gd.valid_chunks(lines(spark, folder)), SAMPLE).select("chunk_id", "page_id", "place")


NEIGHBOURS_SQL = f"""{SAMPLE_SQL},
pairs AS (
  SELECT s.chunk_id AS source_chunk_id, l.chunk_id, l.chunk_id = s.chunk_id AS is_source, l.chunk_index
  FROM sample s JOIN lines l USING (page_id))"""


@query(
    "golden_neighbours",
    f"WITH {NEIGHBOURS_SQL} SELECT source_chunk_id, chunk_id, is_source, chunk_index::BIGINT AS chunk_index FROM pairs",
)
def golden_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    good = gd.valid_chunks(lines(spark, folder))
    return gd.neighbours(gd.sample_chunks(good, SAMPLE), good)


@query(
    "golden_build",
    f"""WITH {NEIGHBOURS_SQL},
asked AS (
  SELECT *, trim(regexp_extract(content, '\\A\\s*([^.!?]*[.!?])', 1), {TRIM}) AS query FROM sample),
numbered AS (
  SELECT *, format('q_{{:03d}}', row_number() OVER (ORDER BY place)) AS query_id FROM asked WHERE query <> '')
SELECT query_id, query, p.chunk_id, p.is_source, p.chunk_index::BIGINT AS chunk_index, page_id::VARCHAR AS source_page, title AS source_title
FROM numbered n JOIN pairs p ON p.source_chunk_id = n.chunk_id""",
)
def golden_build(spark: SparkSession, folder: str) -> DataFrame:
    """Sample, question, dense ids and relevant chunks of a golden set, one row per pair."""
    good = gd.valid_chunks(lines(spark, folder))
    sample = gd.sample_chunks(good, SAMPLE)
    asked = gd.number_queries(gd.first_sentence_questions(sample))
    pairs = gd.golden_pairs(asked, gd.neighbours(sample, good))
    return pairs.select(
        "query_id", "query", "chunk_id", "is_source", "chunk_index", F.col("page_id").cast("string").alias("source_page"),
        F.col("title").alias("source_title"),
    )


@query(
    "golden_validate",
    """WITH rows_in AS (
  SELECT event_id, user_id, event_type, value, (props->>'$.k')::INT AS k FROM events),
judged AS (
  SELECT *, CASE WHEN event_type = 'error' THEN 'malformed JSON' WHEN k < 10 THEN 'missing queryId' WHEN k < 20 THEN 'missing query'
      WHEN k < 30 THEN 'missing relevantChunkIds' WHEN k < 40 THEN 'empty relevantChunkIds' WHEN k < 50 THEN 'empty relevant id' END AS problem
  FROM rows_in WHERE event_type <> 'click'),
firsts AS (SELECT user_id, min(event_id) AS first FROM judged WHERE problem IS NULL GROUP BY user_id)
SELECT event_id AS line_number, CASE WHEN event_type = 'error' OR k < 10 THEN NULL ELSE 'q_' || user_id END AS query_id,
       CASE WHEN problem IS NULL AND event_id > first THEN 'duplicate queryId' ELSE problem END AS problem
FROM judged LEFT JOIN firsts USING (user_id)""",
)
def golden_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSONL lines with all kinds of faults; clicks are blank lines."""
    events = spread(table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")))
    k = F.col("k")
    name = F.when(k < 10, F.lit("")).otherwise(F.concat(F.lit('"queryId": "q_'), F.col("user_id"), F.lit('", ')))
    text = F.when((k >= 10) & (k < 20), F.lit('"query": 5')).otherwise(F.concat(F.lit('"query": "'), "event_type", F.lit('"')))
    ids = (
        F.when((k >= 20) & (k < 30), F.lit(""))
        .when((k >= 30) & (k < 40), F.lit(', "relevantChunkIds": []'))
        .when((k >= 40) & (k < 50), F.lit(', "relevantChunkIds": ["a", ""]'))
        .otherwise(F.lit(', "relevantChunkIds": ["a", "b"]'))
    )
    whole = F.concat(F.lit("{"), name, text, ids, F.lit(', "extra": 1}'))
    line = F.when(F.col("event_type") == "click", F.lit("  ")).when(F.col("event_type") == "error", F.substring(whole, 1, 9)).otherwise(whole)
    numbered = events.select(F.col("event_id").alias("line_number"), line.alias("line"))
    return gd.check_golden_lines(numbered).select("line_number", "query_id", "problem")
