"""Named queries over the driver's tables, each beside its SQL twin for DuckDB where SQL can express it.

Tables without a counterpart in document conversion stand in for the engine's own (a usage ledger, a cache, run items);
the stand-ins are named in each query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fields as X, text as T, urls as U
from ..functions.batches import small_batches
from ..operators import caches, naming, pages, routing, runs, usage

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracle: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _oracle[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


CJK = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}]"
WORDS = f"(len(regexp_extract_all(text, '{CJK}')) + len(regexp_extract_all(regexp_replace(text, '{CJK}', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+')))"
TOKENS = "((2 * length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + 5 * (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) + 4) // 5)"


@query(f"SELECT lang, count(*) AS docs, CAST(sum({WORDS}) AS BIGINT) AS words, CAST(sum({TOKENS}) AS BIGINT) AS tokens, "
       "count(*) FILTER (length(text) > 32000) AS over_limit FROM documents GROUP BY lang")  # fmt: skip
def word_count_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum(T.word_count(F.col("text"))).alias("words"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"),
        F.count_if(F.length("text") > 32000).alias("over_limit"),
    )


@query(f"SELECT conv_id, CAST(sum({TOKENS}) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_tokens(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("turns"))


@query("""
WITH c AS (SELECT conv_id, turn, regexp_replace(text, '\\s', '', 'g') AS a,
    regexp_replace(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '\\s', '', 'g') AS b FROM conversations),
g AS (SELECT conv_id, turn, length(a) AS na, length(b) AS nb,
    CASE WHEN length(a) > 1 THEN list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) ELSE [] END AS ga,
    CASE WHEN length(b) > 1 THEN list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) ELSE [] END AS gb
    FROM c WHERE b IS NOT NULL)
SELECT conv_id, turn, na < 200 OR (nb * 5 >= na AND len(list_intersect(ga, gb)) * 10 >= len(ga) * 3) AS plausible FROM g
""")
def plausible_rewrites(spark, sf_dir):
    """Each turn of a conversation against the next one, which stands in for a model's rewrite of it."""
    from pyspark.sql.window import Window

    turns = table(spark, sf_dir, "conversations")
    pair = turns.withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("answer is not null")
    return pair.select("conv_id", "turn", T.plausible(F.col("text"), F.col("answer")).alias("plausible"))


@query("""SELECT page_id, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(html, '`+'), lambda x: length(x))), 0) + 1)) AS fence,
CASE WHEN length(html) > 40000 THEN substr(html, 1, 2000) ELSE html END AS preview FROM pages""")
def fences_and_previews(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.fence(F.col("html")).alias("fence"), T.preview(F.col("html")).alias("preview"))


@query("""
WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?m)^(# .*|##.*)$', 1),
  lambda h: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(
    regexp_replace(h, '^#+', ''), '\\s+', ' ', 'g')), '^#{1,6}\\s+', ''), '!?\\[([^\\]]*)\\]\\([^)]+\\)', '\\1', 'g'),
    '(?i)</?(?:strong|em|b|i|code)>', '', 'g'), '\\*\\*', '', 'g'), '\\\\([!-/:-@\\[-`{-~])', '\\1', 'g'), '', ''))), lambda h: h <> '') AS hs FROM documents)
SELECT doc_id, coalesce(hs[1], 'doc-' || doc_id) AS title FROM l
""")
def titles_from_headings(spark, sf_dir):
    fallback = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", T.title_of(F.col("text"), fallback).alias("title"))


@query("""
WITH l AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
r AS (SELECT key, pos, trim(raw) AS line, starts_with(trim(raw), '|') AS is_row, lag(starts_with(trim(raw), '|')) OVER (PARTITION BY key ORDER BY pos) AS before FROM l),
t AS (SELECT key, pos, line, is_row, sum(CASE WHEN is_row AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pos) AS tab FROM r),
c AS (SELECT key, pos, tab, len(string_split(regexp_replace(regexp_replace(line, '\\\\\\|', 'x', 'g'), '^\\||\\|$', '', 'g'), '|')) AS cells FROM t WHERE is_row),
f AS (SELECT *, first_value(cells) OVER (PARTITION BY key, tab ORDER BY pos) AS expected FROM c)
SELECT key, CAST(pos AS INT) AS pos, CAST(cells AS INT) AS cells, CAST(expected AS INT) AS expected FROM f WHERE cells <> expected
""")
def table_warnings(spark, sf_dir):
    return pages.table_warnings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
WITH l AS (SELECT source AS book, doc_id AS page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT book, page, pos, trim(translate(raw, chr(9) || chr(13), '  ')) AS line FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY pos DESC) AS e, count(*) OVER (PARTITION BY book, page) AS n FROM t WHERE line <> ''),
s AS (SELECT * FROM n WHERE e <= 4 AND n >= 2 AND length(line) < 30 AND NOT regexp_matches(line, '^[#!\\[\\-*|>`~<]')),
b AS (SELECT book, count(DISTINCT page) AS of_pages FROM s GROUP BY book)
SELECT s.book, line, count(*) AS pages, of_pages FROM s JOIN b USING (book) WHERE NOT regexp_matches(line, '^\\p{N}+$')
GROUP BY s.book, line, of_pages HAVING of_pages >= 3 AND count(*) * 50 >= of_pages
""")
def repeated_page_endings(spark, sf_dir):
    """Sources stand in for books, their documents for pages; endings on a fiftieth of the pages (books of this corpus are not paged)."""
    return pages.repeated_footers(table(spark, sf_dir, "documents"), "source", "doc_id", "text", share=50)


@query("""
WITH l AS (SELECT doc_id AS key, unnest(regexp_split_to_array(text, '\\n+')) AS block, generate_subscripts(regexp_split_to_array(text, '\\n+'), 1) - 1 AS pos FROM documents),
b AS (SELECT key, pos, block, lag(block) OVER (PARTITION BY key ORDER BY pos) AS before FROM l WHERE trim(block) <> '')
SELECT key, CAST(pos AS INT) AS pos, block FROM b WHERE block = before AND length(block) >= 30
""")
def repeated_blocks(spark, sf_dir):
    return pages.repeated_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
WITH l AS (SELECT doc_id AS key, regexp_replace(unnest(string_split(text, chr(10))), '\\s+$', '') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (SELECT *, CASE WHEN line <> coalesce(lag(line) OVER (PARTITION BY key ORDER BY pos DESC), line) THEN 1 ELSE 0 END AS changed FROM l WHERE line <> ''),
i AS (SELECT *, sum(changed) OVER (PARTITION BY key ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS island FROM c),
u AS (SELECT key, max(line) AS unit, count(*) AS copies FROM i WHERE island = 0 GROUP BY key),
m AS (SELECT *, regexp_replace(unit, '\\s', '', 'g') AS solid FROM u),
w AS (SELECT *, length(solid) * 2 - length(regexp_replace(solid, '[^\\x00-\\x7F]', '', 'g')) AS weight,
  starts_with(ltrim(unit), '|') OR length(regexp_replace(solid, '[^\\p{L}\\p{N}]', '', 'g')) * 2 < length(solid) AS structural FROM m)
SELECT key, unit, copies FROM w WHERE length(solid) > 0 AND copies >= CASE WHEN structural THEN 64 ELSE 6 END
  AND copies * weight >= CASE WHEN structural THEN 1024 ELSE 120 END
""")
def repeated_tails(spark, sf_dir):
    return pages.repeated_tails(table(spark, sf_dir, "documents"), "doc_id", "text")


HOST = "lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


@query(f"""SELECT page_id, {HOST} AS authority, {HOST} AS host, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query, regexp_matches(url, '(?i)^https?://') AS is_url FROM pages""")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.authority(url).alias("authority"), U.host(url).alias("host"), U.query_text(url).alias("query"), U.is_url(url).alias("is_url"))


@query("""
WITH p AS (SELECT page_id, page_id % 5 AS k, 'https://' || regexp_extract(url, '^https?://([^?#]*)', 1) AS u FROM pages)
SELECT page_id, u || CASE k WHEN 0 THEN '?a=b+c%26d&apiKey=REDACTED&e=' WHEN 1 THEN '?a=%7Eb&x=%2f' WHEN 2 THEN '#access_token=REDACTED&type=bearer' WHEN 3 THEN '?token=REDACTED#sec-2' ELSE '?q=1#part-two' END AS redacted FROM p
""")
def url_redaction(spark, sf_dir):
    """Pages' addresses with credentials before the host, and with secret parameters in the query, the fragment or nowhere."""
    bare = F.regexp_extract("url", "^https?://([^?#]*)", 1)
    more = F.element_at(
        F.array(*map(F.lit, ("?a=b%20c%26d&apiKey=abc&e", "?a=%7Eb&x=%2f", "#access_token=abc.def&type=bearer", "?token=q#sec-2", "?q=1#part-two"))), (F.col("page_id") % 5 + 1).cast("int")
    )
    return table(spark, sf_dir, "pages").select("page_id", U.redact(F.concat(F.lit("https://me:secret@"), bare, more)).alias("redacted"))


@query("""
WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^(?i:https?)://([^/?#:]+)', 1)), '\\.', '_', 'g') AS place,
  list_filter(string_split(regexp_extract(url, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segs, contains(url, '?') AS queried,
  regexp_extract(url, '[?&](?:id|v|p|pid|tid|nid|aid|vid)=([^&#]+)', 1) AS ident FROM pages)
SELECT page_id, regexp_replace(regexp_replace(CASE WHEN len(segs) > 0 THEN CASE WHEN queried THEN place || '_' || segs[-1] || CASE WHEN ident <> '' AND NOT contains(segs[-1], ident) THEN '_' || ident ELSE '' END ELSE segs[-1] END
  ELSE place || CASE WHEN ident <> '' THEN '_' || ident ELSE '' END END, '[<>:"/\\\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS name FROM p
""")
def url_output_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.output_name(F.col("url")).alias("name"))


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_~.-]{24,}')) AS segment FROM documents),
c AS (SELECT segment, string_split(segment, '') AS chars FROM w),
e AS (SELECT segment, len(list_distinct(chars)) AS kinds, list_sum(list_transform(list_distinct(chars),
  lambda x: -(len(list_filter(chars, lambda y: y = x)) / length(segment)) * log2(len(list_filter(chars, lambda y: y = x)) / length(segment)))) AS entropy FROM c)
SELECT segment, round(entropy, 6) AS entropy, regexp_matches(segment, '^[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}$')
  OR (NOT regexp_matches(segment, '^[0-9A-Fa-f-]+$') AND regexp_matches(segment, '[a-z]') AND regexp_matches(segment, '[A-Z]') AND regexp_matches(segment, '[0-9]')
  AND kinds >= 10 AND entropy >= 3.5) AS is_opaque FROM e
""")
def opaque_segments(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_~.-]{24,})"), 1)).alias("segment")).distinct()
    s = F.col("segment")
    return found.select("segment", F.round(T.entropy(s), 6).alias("entropy"), U.is_opaque(s).alias("is_opaque"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(p_name || CASE p_partkey % 4 WHEN 0 THEN '?' WHEN 1 THEN ' .' WHEN 2 THEN '/a:b' ELSE '' END, '[\\x00-\\x1F\\x7F-\\x9F<>:"/\\\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS name FROM part""")
def file_names(spark, sf_dir):
    n = F.col("p_partkey") % 4
    raw = F.concat("p_name", F.when(n == 0, "?").when(n == 1, " .").when(n == 2, "/a:b").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", T.file_name(raw).alias("name"))


@query(f"""
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN o_orderpriority WHEN 2 THEN CAST(o_custkey AS VARCHAR)
  WHEN 3 THEN 'no' WHEN 4 THEN 'it''s: so' ELSE '' END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v = '' OR regexp_matches(v, '{T.YAML_NOT_TEXT}') OR regexp_matches(v, '^[\\s\\-?:,\\[\\]{{}}#&*!|>''"%@`]|: |:$| #|\\s$')
  THEN '''' || replace(v, '''', '''''') || '''' ELSE v END AS scalar FROM v
""")
def yaml_scalars(spark, sf_dir):
    n = F.col("o_orderkey") % 6
    v = (
        F.when(n == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(n == 1, F.col("o_orderpriority")).when(n == 2, F.col("o_custkey").cast("string"))
        .when(n == 3, "no").when(n == 4, "it's: so").otherwise("")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.yaml_scalar(v).alias("scalar"))


@query("SELECT page_id, substr(sha256('pages' || chr(0) || url || chr(0) || 'static'), 1, 32) AS cache_key FROM pages")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", caches.cache_key("pages", F.col("url"), F.lit("static")).alias("cache_key"))


@query("""SELECT event_id, coalesce(sum(coalesce(length(props), 0) + 100) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING), 0) > 500 AS evicted FROM events""")
def lru_eviction(spark, sf_dir):
    """Events stand in for cache rows, users for the cache's shards."""
    rows = table(spark, sf_dir, "events").withColumn("size", F.coalesce(F.length("props"), F.lit(0)) + 100)
    return caches.lru_evict(rows, ["user_id"], "size", "ts", "event_id", 500).select("event_id", "evicted")


@query("""
WITH c AS (SELECT user_id, max(ts) AS created_at FROM events WHERE event_id % 2 = 0 GROUP BY user_id)
SELECT e.event_id, CASE WHEN c.user_id IS NULL THEN 'miss' WHEN epoch(TIMESTAMP '2024-06-01') - floor(epoch(c.created_at)) <= 7776000 THEN 'hit' ELSE 'stale' END AS state
FROM events e LEFT JOIN c ON e.user_id = c.user_id
""")
def cache_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cache = events.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("created_at"))
    return caches.lookup(events, cache, "user_id", F.lit("2024-06-01").cast("timestamp"), 90 * 86400).select("event_id", "state")


@query("SELECT event_type, count(*) AS entries, CAST(sum(coalesce(length(props), 0)) AS BIGINT) AS bytes FROM events GROUP BY event_type")
def cache_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("entries"), F.sum(F.coalesce(F.length("props"), F.lit(0)).cast("long")).alias("bytes"))


@query(f"""
WITH h AS (SELECT {HOST} AS domain, TIMESTAMP '2024-01-01' + INTERVAL (page_id % 60) DAY AS hit_at FROM pages),
s AS (SELECT domain, min(hit_at) AS learned_at, max(hit_at) AS last_hit, count(*) AS hits FROM h GROUP BY domain)
SELECT * FROM s WHERE date_diff('day', last_hit, TIMESTAMP '2024-03-05') <= 30 ORDER BY hits DESC, domain LIMIT 4096
""")
def learnt_routes(spark, sf_dir):
    at = F.expr("timestamp'2024-01-01' + make_dt_interval(cast(page_id % 60 as int))")
    hits = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("domain"), at.alias("at"))
    return caches.learn_routes(hits, "domain", "at", 30, F.lit("2024-03-05").cast("timestamp"), 4096)


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN upper(p_brand) || '.V' || (p_partkey % 9 + 1) ELSE p_brand END AS name FROM part),
n AS (SELECT p_partkey, name, lower(name) AS base, row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey) AS k FROM p),
free AS (SELECT base, v, row_number() OVER (PARTITION BY base ORDER BY v) AS j FROM (SELECT base, unnest(range(2, count(*) + 100)) AS v FROM n GROUP BY base) f
  WHERE base || '.v' || v NOT IN (SELECT base FROM n))
SELECT p_partkey, CASE WHEN k > 1 THEN name || '.v' || v ELSE name END AS unique_name FROM n LEFT JOIN free ON n.base = free.base AND free.j = n.k - 1
""")
def unique_names(spark, sf_dir):
    """Parts' brands as names; some rows already bear the name of a version."""
    n = F.col("p_partkey")
    name = F.when(n % 5 == 0, F.concat(F.upper("p_brand"), F.lit(".V"), (n % 9 + 1).cast("string"))).otherwise(F.col("p_brand"))
    return naming.unique_names(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("""
WITH e AS (SELECT lower(p_name) || CASE p_partkey % 6 WHEN 0 THEN '.v7' ELSE '' END AS n FROM part WHERE p_partkey % 3 = 0),
i AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 10 = 0 THEN '.v7' ELSE '' END AS name FROM part)
SELECT p_partkey, 'write' AS action, CASE WHEN lower(name) NOT IN (SELECT n FROM e) THEN name WHEN lower(name) || '.v7' IN (SELECT n FROM e) THEN name || '.v8' ELSE name || '.v2' END AS target FROM i
""")
def output_plan(spark, sf_dir):
    """A third of the parts' names exist, half of these only as a seventh version; some new names are such a version too."""
    part, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    existing = part.filter("p_partkey % 3 = 0").select(F.concat("p_name", F.when(n % 6 == 0, ".v7").otherwise("")).alias("name"))
    items = part.select("p_partkey", F.concat("p_name", F.when(n % 10 == 0, ".v7").otherwise("")).alias("new"))
    return naming.plan_outputs(items, existing, "new", "rename").select("p_partkey", "action", "target")


@query("""
WITH t AS (SELECT page_id AS list_id, CASE WHEN page_id % 5 = 0 THEN '# note' || chr(10) ELSE '' END || url || CASE WHEN page_id % 4 = 0 THEN ' "n' || page_id || '"' ELSE '' END || chr(10) || url AS body FROM pages),
l AS (SELECT list_id, trim(unnest(string_split(body, chr(10)))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS place FROM t),
e AS (SELECT list_id, place, regexp_extract(line, '^(\\S+)', 1) AS url, nullif(trim(regexp_replace(regexp_extract(line, '^\\S+\\s+(.*)$', 1), '^[''"]|[''"]$', '', 'g')), '') AS name FROM l WHERE line <> '' AND line[1] <> '#'),
k AS (SELECT *, row_number() OVER (PARTITION BY concat_ws(' ', url, name) ORDER BY list_id, place) AS k FROM e)
SELECT list_id, CAST(place AS INT) AS place, url, name FROM k WHERE k = 1
""")
def url_lists(spark, sf_dir):
    """A URL list of every page's address, with a note, a name and a second line here and there, parsed and de-duplicated; the
    first of each address and name stays."""
    n = F.col("page_id")
    name = F.when(n % 4 == 0, F.concat(F.lit(' "n'), n.cast("string"), F.lit('"'))).otherwise("")
    lists = table(spark, sf_dir, "pages").select(n.alias("list_id"), F.concat(F.when(n % 5 == 0, "# note\n").otherwise(""), "url", name, F.lit("\n"), "url").alias("body"))
    entries = naming.parse_url_list(lists, "list_id", "body")
    return naming.first_of_each(entries, F.concat_ws(" ", "url", "name"), ["list_id", "place"]).select("list_id", "place", "url", "name")


LEDGER = """SELECT CASE l_suppkey % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE 'delta' END AS model, 1 AS requests,
  CAST(l_partkey * 170 % 400000 AS BIGINT) AS prompt_tokens, CAST(l_quantity AS BIGINT) AS completion_tokens, l_orderkey, l_linenumber, l_returnflag = 'R' AS batch FROM lineitem"""


def _ledger(spark, sf_dir):
    """Line items stand in for model requests."""
    n = F.col("l_suppkey") % 4
    model = F.when(n == 0, "alpha").when(n == 1, "beta").when(n == 2, "gamma").otherwise("delta")
    return table(spark, sf_dir, "lineitem").select(
        model.alias("model"), F.lit(1).cast("long").alias("requests"), (F.col("l_partkey") * 170 % 400000).alias("prompt_tokens"),
        F.col("l_quantity").cast("long").alias("completion_tokens"), "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("batch"),
        F.lit(0).cast("long").alias("cached_tokens"),
    )


#: model, low, high, input, output (picodollars a token); alpha is not priced between its bands, delta not at all.
TARIFFS = [("alpha", 0, 272000, 1250000, 10000000), ("alpha", 278529, 1 << 40, 2500000, 15000000), ("beta", 0, 200000, 3000000, 15000000), ("gamma", 0, 1 << 40, 75000, 300000)]
QUOTED = f"""
WITH r AS ({LEDGER}), t(model, low, high, input, output) AS (VALUES {', '.join(map(str, TARIFFS))}),
q AS (SELECT r.*, CASE WHEN t.model IS NULL THEN NULL ELSE CAST(prompt_tokens AS HUGEINT) * input + CAST(completion_tokens AS HUGEINT) * output END AS x
  FROM r LEFT JOIN t ON r.model = t.model AND prompt_tokens BETWEEN low AND high)
"""


def _quoted(spark, sf_dir):
    tariffs = spark.createDataFrame(TARIFFS, "model string, low long, high long, input long, output long")
    return usage.quote(_ledger(spark, sf_dir), tariffs)


@query(QUOTED + "SELECT l_orderkey, l_linenumber, CASE WHEN x IS NULL THEN 'unpriced' ELSE CAST(CASE WHEN batch THEN x // 2 ELSE x END AS VARCHAR) END AS picodollars FROM q")
def price_quotes(spark, sf_dir):
    pico = F.round(F.col("cost_usd") * F.lit("1000000000000").cast("decimal(13,0)"), 0).cast("decimal(38,0)")
    return _quoted(spark, sf_dir).select("l_orderkey", "l_linenumber", F.coalesce(pico.cast("string"), F.lit("unpriced")).alias("picodollars"))


@query(QUOTED + """, m AS (SELECT model, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS input_tokens, CAST(sum(completion_tokens) AS BIGINT) AS output_tokens,
  CAST(count(x) AS BIGINT) AS priced_requests, CAST(count(*) - count(x) AS BIGINT) AS unpriced_requests FROM q GROUP BY model)
SELECT *, CASE WHEN unpriced_requests = 0 THEN 'complete' WHEN priced_requests > 0 THEN 'partial' ELSE 'unknown' END AS cost_status FROM m""")
def usage_by_model(spark, sf_dir):
    ledger = _quoted(spark, sf_dir).withColumnsRenamed({"prompt_tokens": "input_tokens", "completion_tokens": "output_tokens"})
    merged = usage.merge_usage(ledger).drop("cost_usd")
    return merged.withColumn("cost_status", usage.cost_status(F.col("priced_requests"), F.col("unpriced_requests")))


ITEMS = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'url' ELSE 'file' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_orderkey % 10 = 1 THEN 'failed' ELSE 'skipped' END ELSE 'pending' END AS status,
  o_custkey AS source, o_orderkey % 5 = 0 AS cached, o_totalprice / 1000 AS seconds, o_orderpriority AS job FROM orders"""


def _items(spark, sf_dir):
    """Orders stand in for run items."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(s == "F", "completed").when(s == "O", F.when(k % 10 == 1, "failed").otherwise("skipped")).otherwise("pending")
    return table(spark, sf_dir, "orders").select(
        k, F.when(k % 3 == 0, "url").otherwise("file").alias("kind"), status.alias("status"), F.col("o_custkey").alias("source"),
        (k % 5 == 0).alias("cached"), (F.col("o_totalprice") / 1000).alias("seconds"), F.col("o_orderpriority").alias("job"),
    )


REPORT = """count(*) AS total, count(*) FILTER (status IN ('completed', 'skipped')) AS completed, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status IN ('failed', 'pending')) AS pending, count(*) FILTER (cached) AS cache_hits, count(DISTINCT source) AS sources, round(sum(seconds), 4) AS seconds"""


@query(f"SELECT kind, {REPORT} FROM ({ITEMS}) GROUP BY kind")
def run_report(spark, sf_dir):
    return runs.report(_items(spark, sf_dir), ["kind"])


@query(f"""SELECT job, CASE WHEN count(*) FILTER (status = 'pending') > 0 THEN 'running' WHEN count(*) FILTER (status = 'failed') = count(*) THEN 'failed'
  WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial' ELSE 'completed' END AS job_status, count(*) AS items, count(*) FILTER (status = 'failed') AS failed FROM ({ITEMS}) GROUP BY job""")
def job_status(spark, sf_dir):
    return runs.job_status(_items(spark, sf_dir), "job")


@query("""SELECT user_id, CASE WHEN arg_max(event_type, event_id) = 'view' THEN 'failed' ELSE arg_max(event_type, event_id) END AS status, max(event_id) AS applied, count(*) AS events,
  arg_max(value, event_id) FILTER (event_id % 3 = 0 AND value IS NOT NULL) AS output FROM events GROUP BY user_id""")
def replayed_state(spark, sf_dir):
    """Events stand in for journal records: latest status, latest output that is present; `view` is the running state."""
    e = table(spark, sf_dir, "events").withColumn("output", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    e = e.withColumn("status", F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")))
    return runs.replay(e, "user_id", "event_id", ["output"], "status")


@query("""
WITH s AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN 'completed' ELSE 'failed' END AS status FROM customer WHERE c_custkey % 4 <> 0),
f AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT coalesce(s.k, f.k) AS custkey, coalesce(status, 'pending') AS status, coalesce(status, 'pending') <> 'completed' AS todo, f.k IS NULL AS gone FROM s FULL JOIN f ON s.k = f.k
""")
def resumed_run(spark, sf_dir):
    """Customers stand in for saved state, orders for what is found again."""
    saved = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("custkey"), F.when(F.col("c_acctbal") > 0, "completed").otherwise("failed").alias("status"))
    return runs.resume(saved, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS latency FROM events")
def routing_latency(spark, sf_dir):
    calls = runs.recent_latency(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    return calls.select("event_id", F.round("latency", 6).alias("latency"))


@query("SELECT event_type AS route, date_trunc('minute', ts) AS minute, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def routing_minutes(spark, sf_dir):
    return runs.per_minute(table(spark, sf_dir, "events"), "event_type", "ts", "value")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN ['playwright'] ELSE ['static', 'playwright'] END
  WHEN page_id % 2 = 0 THEN ['playwright', 'defuddle', 'jina', 'cloudflare'] ELSE ['static', 'playwright', 'defuddle', 'jina'] END AS strategies FROM pages""")
def fetch_strategies(spark, sf_dir):
    n, no, none = F.col("page_id"), F.lit(False), F.lit(None).cast("string")
    order = X.strategy_order(n % 3 == 0, no, n % 2 == 0, no, F.lit(True), F.array().cast("array<string>"), none, F.lit(True), F.lit(4))
    return table(spark, sf_dir, "pages").select("page_id", order.alias("strategies"))


@query("SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS INT) AS batch FROM conversations")
def visual_batches(spark, sf_dir):
    """Turns stand in for page frames, two to a batch."""
    return runs.batches(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "batch")


@query("SELECT doc_id, CASE WHEN length(t) > 150 THEN substr(t, 1, 147) || '...' ELSE t END AS description FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def descriptions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.description(F.col("text")).alias("description"))


@query("SELECT p_partkey, substr(regexp_replace(regexp_replace(trim(p_type || ': ' || p_name), '[\"'']', '', 'g'), '[\\s:]+', '-', 'g'), 1, 30) AS tag FROM part")
def tags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.tag(F.concat("p_type", F.lit(": "), "p_name")).alias("tag"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END AS size,
  CASE WHEN s < 60 THEN printf('%.1fs', s :: DOUBLE) WHEN s < 3600 THEN lpad((s // 60) :: VARCHAR, 2, '0') || ':' || lpad((s % 60) :: VARCHAR, 2, '0')
  ELSE lpad((s // 3600) :: VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60) :: VARCHAR, 2, '0') || ':' || lpad((s % 60) :: VARCHAR, 2, '0') END AS duration
FROM (SELECT l_orderkey, l_linenumber, l_partkey * l_orderkey * 3 AS n, l_orderkey * 7 % 40000 AS s FROM lineitem)""")
def sizes_and_durations(spark, sf_dir):
    n, s = F.col("l_partkey") * F.col("l_orderkey") * 3, F.col("l_orderkey") * 7 % 40000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.byte_size(n).alias("size"), T.duration(s).alias("duration"))


@query("""WITH c AS (SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus || chr(10) || o_custkey AS cell FROM orders)
SELECT o_orderkey, regexp_replace(replace(cell, '|', '\\|'), '\\r\\n|\\r|\\n', '<br>', 'g') AS cell FROM c""")
def table_cells(spark, sf_dir):
    cell = F.concat("o_orderpriority", F.lit("|"), "o_orderstatus", F.lit("\n"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.table_cell(cell).alias("cell"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'word' WHEN 1 THEN 'html' WHEN 2 THEN 'delimited' WHEN 3 THEN 'image' WHEN 4 THEN 'notebook' ELSE NULL END AS reader FROM part""")
def reader_dispatch(spark, sf_dir):
    n = F.col("p_partkey") % 6
    path = F.concat("p_name", F.when(n == 0, ".DOTX").when(n == 1, ".htm").when(n == 2, ".tsv").when(n == 3, ".PNG").when(n == 4, ".ipynb").otherwise(".zzz"))
    return routing.with_reader(table(spark, sf_dir, "part").withColumn("path", path), "path").select("p_partkey", "reader")


@query("""SELECT sha256(text) AS sha, min(doc_id) AS target, count(*) AS uses FROM documents GROUP BY 1""")
def asset_targets(spark, sf_dir):
    """Documents stand in for assets: equal bytes share the first one's target."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("target"), F.count("*").alias("uses"))


@query("""SELECT count(*) AS requests, count(DISTINCT sha256(text)) AS calls, CAST(sum(CASE WHEN k = 1 THEN tokens ELSE 0 END) AS BIGINT) AS uncached,
  CAST(sum(CASE WHEN k = 1 THEN tokens ELSE 0 END) AS BIGINT) + CAST(ceil(sum(CASE WHEN k = 1 THEN tokens ELSE 0 END) / 5.0) AS BIGINT) <= 1000000 AS within_budget
FROM (SELECT text, """ + TOKENS + """ AS tokens, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents)""")  # fmt: skip
def coalesced_budget(spark, sf_dir):
    """Equal requests are made once; the budget must hold them and a fifth more."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), T.token_estimate(F.col("text")).alias("tokens"))
    once = docs.groupBy("sha").agg(F.max("tokens").alias("tokens"), F.count("*").alias("n"))
    need = F.sum("tokens")
    return once.agg(F.sum("n").alias("requests"), F.count("*").alias("calls"), need.alias("uncached"), (need + F.ceil(need / 5) <= 1000000).alias("within_budget"))


@query("SELECT event_id, strftime(make_timestamp((event_id * 86400000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS filetime, CASE WHEN event_id * 7000000000000 >= 30000000000 THEN strftime(make_timestamp((((event_id * 7000000000000) >> 22) + 1288834974657) * 1000), '%Y-%m-%dT%H:%M:%SZ') END AS posted FROM events")
def id_dates(spark, sf_dir):
    """Events' numbers as days and as post ids, multiplied as decimals: 64 bits hold neither for numbers beyond some millions."""
    iso = lambda c: F.ltrim(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("+"))  # noqa: E731  years of five digits have no sign
    number = F.col("event_id").cast("decimal(19, 0)")
    ticks, post = number * 864000000000 + 116444736000000000, number * 7000000000000
    return table(spark, sf_dir, "events").select(
        "event_id", iso(routing.from_filetime(ticks)).alias("filetime"), iso(routing.from_post_id(post)).alias("posted")
    )


@query("SELECT page_id, regexp_matches(url, '^https?://[^/]*/[^?#]*') AND NOT contains(url, 'ref=') AS kept FROM pages")
def glob_filter(spark, sf_dir):
    return routing.matching(table(spark, sf_dir, "pages"), "url", ["**"], ["**ref=**"]).select("page_id", "kept")


@query("""SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'https://x.com/u' || user_id || '/status/' || (user_id * 7) ELSE NULL END AS post,
  user_id % 4 = 1 OR user_id % 4 = 3 AS private, CASE user_id % 4 WHEN 2 THEN 'https://e.com/' || user_id ELSE NULL END AS target FROM (SELECT DISTINCT user_id FROM events)""")
def url_kinds(spark, sf_dir):
    """Addresses made of user numbers: posts on a mirror, private hosts, outward links."""
    n, u = F.col("user_id") % 4, F.col("user_id").cast("string")
    url = (
        F.when(n == 0, F.concat(F.lit("https://mobile.twitter.com/u"), u, F.lit("/status/"), (F.col("user_id") * 7).cast("string"), F.lit("/photo/1?s=20")))
        .when(n == 1, F.concat(F.lit("http://192.168.1."), u, F.lit("/"))).when(n == 3, F.concat(F.lit("https://wiki.internal/"), u))
        .otherwise(F.concat(F.lit("https://link.e.org/?a=1&target=https%3A%2F%2Fe.com%2F"), u))
    )
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("url", url)
    c = F.col("url")
    return users.select("user_id", U.post_url(c).alias("post"), U.is_private(c).alias("private"), F.when(n == 2, U.redirect_target(c)).alias("target"))


@query("SELECT p_partkey FROM part WHERE p_size * 3 >= 50 AND p_partkey % 200 >= 50 AND p_size * 3 * (p_partkey % 200) >= 5000")
def shown_images(spark, sf_dir):
    """Parts stand in for images."""
    images = table(spark, sf_dir, "part").withColumns({"width": F.col("p_size") * 3, "height": F.col("p_partkey") % 200})
    return routing.shown_images(images).select("p_partkey")


@query("""WITH w AS (SELECT DISTINCT event_type || CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS word FROM events), k AS (SELECT DISTINCT event_type AS name FROM events),
p AS (SELECT word, name, levenshtein(word, name) AS d FROM w, k WHERE levenshtein(word, name) <= 2)
SELECT word, arg_min(name, (d, name)) AS suggestion, CAST(min(d) AS INT) AS edits FROM p GROUP BY word""")
def suggestions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    word = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "x").otherwise(""))
    return routing.suggestions(e.select(word.alias("word")).distinct(), e.select(F.col("event_type").alias("name")).distinct())


@query("SELECT substr(sha256(text), 1, 16) AS custom_id, count(*) AS uses FROM conversations GROUP BY 1")
def batch_plan(spark, sf_dir):
    requests = table(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("prompt"))
    return routing.batch_lines(requests, "m").select("custom_id", "uses")


@query(QUOTED + """, m AS (SELECT batch, model, count(*) - count(x) AS unpriced FROM q GROUP BY batch, model)
SELECT batch, 'no price is known for ' || string_agg(model, ', ' ORDER BY model) AS warning FROM m WHERE unpriced > 0 GROUP BY batch""")
def unpriced_warnings(spark, sf_dir):
    by = _quoted(spark, sf_dir).groupBy("batch", "model").agg(F.count_if(F.col("cost_usd").isNull()).alias("unpriced_requests"))
    return usage.unpriced_warning(by, "batch")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import documents, fields  # noqa: F401  they register their queries

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_oracle)
