"""Queries over small fields: dates, numbers, labels, keys, messages and decisions, each beside its SQL twin.

Columns of the driver's tables are dressed up as such fields; the twins say the rule in another way where they can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X, markdown as M, text as T, urls as U
from ..operators import pages as P, render, rewriting, routing, runs, usage
from ..sources import plain
from .registry import query, table


def pick(n, *values):
    """The n-th of some values, modulo their number."""
    return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


EA = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{323AF}]"


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{EA}')) + len(regexp_extract_all(regexp_replace(text, '{EA}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+')) AS BIGINT) AS units FROM documents")
def text_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.text_units(F.col("text")).alias("units"))


@query("""
WITH t AS (SELECT doc_id, doc_id % 5 AS k, substr(text, 1, 200) AS body FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'title: a' || chr(10) || 'tags:' || chr(10) || '- b' || chr(10) END AS front,
  CASE k WHEN 0 THEN regexp_replace(body, '^\\n+', '') WHEN 1 THEN '---' || chr(10) || 'no end' || chr(10) || body
  WHEN 2 THEN '---' || chr(10) || 'just a line' || chr(10) || '---' || chr(10) || body WHEN 3 THEN ' ---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) || body ELSE body END AS body FROM t
""")
def front_matter_parts(spark, sf_dir):
    """Documents with and without front matter; only a mapping between two marks from the first line on is one."""
    body = F.substring("text", 1, 200)
    text = F.concat(pick(F.col("doc_id"), "---\ntitle: a\ntags:\n- b\n---\n\n", "---\nno end\n", "---\njust a line\n---\n", " ---\na: b\n---\n", ""), body)
    return table(spark, sf_dir, "documents").select("doc_id", X.split_front_matter(text).alias("p")).select("doc_id", "p.front", "p.body")


@query("""
WITH t AS (SELECT p_partkey, p_name || chr(9) || ' <' || p_brand || '>' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '[x](y)\\' ELSE '' END AS v FROM part)
SELECT p_partkey, replace(replace(array_to_string(list_filter(string_split_regex(v, '\\s+'), lambda w: w <> ''), ' '), '<', '\\<'), '>', '\\>') AS header,
  translate(replace(replace(array_to_string(list_filter(string_split_regex(replace(v, '\\', '\\\\'), '\\s+'), lambda w: w <> ''), ' '), '<', '\\<'), '>', '\\>'), '[]()', '____') AS label FROM t
""")
def mail_fields(spark, sf_dir):
    v = F.concat("p_name", F.lit("\t <"), "p_brand", F.lit(">\n"), F.when(F.col("p_partkey") % 2 == 0, "[x](y)\\").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_header(v).alias("header"), X.link_label(v).alias("label"))


@query("SELECT doc_id, CAST(length(replace(t, chr(173), '')) AS INT) AS characters, sha256(replace(t, chr(173), '')) AS digest FROM (SELECT doc_id, replace(text, 'e', 'e' || chr(173)) AS t FROM documents)")
def soft_hyphens(spark, sf_dir):
    t = X.without_soft_hyphens(F.regexp_replace("text", "e", "e­"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("characters"), F.sha2(t, 256).alias("digest"))


@query("""
WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a": "x ,} y", "n": [1, 2, ],}' WHEN 1 THEN '{"v": ' || event_id || ' , }' WHEN 2 THEN '{"v": ' || event_id || '}' WHEN 3 THEN '{"v": [1,' ELSE '{''v'': 1,}' END AS j FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a": "x ,} y", "n": [1, 2 ]}' WHEN 1 THEN '{"v": ' || event_id || '  }' END AS repaired FROM t
""")
def json_repairs(spark, sf_dir):
    """Answers of models, some in fences, some beyond repair."""
    n, id_ = F.col("event_id"), F.col("event_id").cast("string")
    j = pick(n, '{"a": "x ,} y", "n": [1, 2, ],}', F.concat(F.lit('```json\n{"v": '), id_, F.lit(" , }\n```")), F.concat(F.lit('{"v": '), id_, F.lit("}")), '{"v": [1,', "{'v': 1,}")
    return table(spark, sf_dir, "events").select("event_id", X.repaired_json(j).alias("repaired"))


@query("""
SELECT event_id, event_id % 8 IN (0, 1, 2) AS reading_time, event_id % 8 IN (3, 4) AS counter FROM events
""")
def label_kinds(spark, sf_dir):
    v = F.floor(F.abs("value")) % 900 + 1
    s = v.cast("string")
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    label = pick(
        F.col("event_id"), say(s, " min read"), say(s, "-minute Reading"), say("Reading time: ", s, "mins"), say(s, ".2K Views"), say("1,", F.lpad(s, 3, "0"), " comments"),
        say(s, " minutes"), say("read ", s, " views later"), say("likes ", s),
    )
    return table(spark, sf_dir, "events").select("event_id", X.is_reading_time(label).alias("reading_time"), X.is_counter(label).alias("counter"))


@query("""SELECT doc_id, k AS place, 'alt' || k AS alt, 'img/' || doc_id || '-' || k || '.png' AS target FROM documents, (SELECT unnest([0, 1]) AS k)""")
def images_of_documents(spark, sf_dir):
    """Documents with two images, a third in a code span and a fourth in a fence."""
    id_ = F.col("doc_id").cast("string")
    image = lambda k, more="": F.concat(F.lit(f"![alt{k}](img/"), id_, F.lit(f"-{k}.png{more})"))
    plain_text = F.regexp_replace(F.substring("text", 1, 500), "[`!\\[~]", "")
    text = F.concat(plain_text, F.lit("\n"), image(0), F.lit(" and `"), image(8), F.lit("` "), image(1, ' "t"'), F.lit("\n```\n"), image(9), F.lit("\n```\n"))
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.image_references(text)).alias("place", "r"))
    return found.select("doc_id", "place", "r.alt", "r.target")


@query("""
WITH t AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + o_custkey AS s, o_orderdate AS d FROM orders)
SELECT o_orderkey, strftime(make_timestamp((s + 28800) * 1000000), '%Y-%m-%dT%H:%M:%S+08:00') AS unix,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(d, '%Y-%m-%dT00:00:00+08:00') WHEN 1 THEN strftime(d, '%Y-%m-%dT17:08:00+08:00') WHEN 2 THEN strftime(d, '%Y-%m-%dT07:08:09+08:00') END AS shown,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(d, '%Y-%m-%dT14:42:28+02:00') WHEN 1 THEN strftime(d, '%Y-%m-%d') WHEN 2 THEN strftime(d, '%Y-01-01') WHEN 3 THEN strftime(d, '%Y-%m-%dT14:42:00Z') END AS pdf FROM t
""")
def shown_dates(spark, sf_dir):
    """Unix times in seconds and milliseconds, dates as pages show them, and PDF dates."""
    n, d = F.col("o_orderkey"), F.col("o_orderdate")
    s = F.unix_timestamp(d) + F.col("o_custkey")
    say = lambda f: F.date_format(d, f)
    shown = pick(n, F.concat(F.lit("am "), say("yyyy'年'M'月'd'日'")), say("yyyy-MM-dd 17:08"), say("yyyy/MM/dd 7:08:09"), "12.1.2020")
    pdf = pick(n, F.concat(F.lit("D:"), say("yyyyMMdd"), F.lit("144228+02'00'")), say("yyyyMMdd"), say("yyyy"), F.concat(say("yyyyMMdd"), F.lit("1442Z")), F.concat(F.lit("D:"), say("yyyy"), F.lit("1399")))
    cols = [X.iso_from_unix(F.when(n % 2 == 0, s).otherwise(s * 1000)).alias("unix"), X.iso_from_text(shown).alias("shown"), X.pdf_date(pdf).alias("pdf")]
    return table(spark, sf_dir, "orders").select("o_orderkey", *cols)


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS cents FROM lineitem),
r AS (SELECT *, sign(cents) * ((abs(cents) + 5) // 10) AS tenths, sign(cents) * ((abs(cents) + 50) // 100) AS units FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN tenths < 0 THEN '-' ELSE '' END || CAST(abs(tenths) // 10 AS BIGINT) || '.' || CAST(abs(tenths) % 10 AS BIGINT) AS one, CAST(CAST(units AS BIGINT) AS VARCHAR) AS none FROM r
""")
def decimal_texts(spark, sf_dir):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    v = cents.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.decimal_text(v, 1).alias("one"), X.decimal_text(v, 0).alias("none"))


LE8 = "unhex(array_to_string(list_transform(range(8), lambda k: substr(lpad(hex(strlen({0})), 16, '0'), CAST(15 - 2 * k AS INT), 2)), ''))"
FRAME = lambda *xs: " || ".join(f"{LE8.format(x)} || encode({x})" for x in xs)


@query(f"""
WITH t AS (SELECT conv_id, turn, role, text, 'v1' AS v, 'native-vision-v1' AS n FROM conversations)
SELECT conv_id, turn, sha256({FRAME("role", "text")}) AS prompt, substr(sha256({FRAME("n", "role", "v", "text")}), 1, 32) AS vision FROM t
""")
def framed_keys(spark, sf_dir):
    """Turns stand in for prompts and page texts."""
    role, text = F.col("role"), F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.prompt_scope(role, text).alias("prompt"), X.vision_key(role, F.lit("v1"), text).alias("vision"))


@query("""SELECT c_custkey, 'pool:' || substr(sha256(CASE WHEN c_mktsegment < c_name THEN c_mktsegment || chr(10) || c_name ELSE c_name || chr(10) || c_mktsegment END), 1, 16) AS scope FROM customer""")
def model_scopes(spark, sf_dir):
    names = F.array(F.col("c_name"), F.lit(""), F.col("c_mktsegment"), F.col("c_name"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.model_scope(names).alias("scope"))


@query("""SELECT p_partkey, substr(md5('{"input": "/in/' || p_partkey || '", "options": {"brand": "' || p_brand || '", "llm": ' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || ', "size": [' || p_size || ', null]}, "output": "/out"}'), 1, 6) AS run FROM part""")
def report_hashes(spark, sf_dir):
    options = F.to_json(F.struct(F.array("p_size", F.lit(None)).alias("size"), (F.col("p_partkey") % 2 == 0).alias("llm"), F.col("p_brand").alias("brand")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "part").select("p_partkey", X.report_hash(F.concat(F.lit("/in/"), F.col("p_partkey").cast("string")), F.lit("/out"), options).alias("run"))


@query("""SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN CASE page_id % 4 WHEN 1 THEN 'https://home.example/' WHEN 2 THEN 'https://home.example/deep/page' ELSE 'https://home.example?x=1' END END AS canonical_all,
  CASE WHEN page_id % 4 = 2 OR (page_id % 4 IN (1, 3) AND replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/', '') = '') THEN CASE page_id % 4 WHEN 1 THEN 'https://home.example/' WHEN 2 THEN 'https://home.example/deep/page' ELSE 'https://home.example?x=1' END END AS canonical FROM pages""")
def canonical_addresses(spark, sf_dir):
    c = pick(F.col("page_id"), F.lit(None).cast("string"), "https://home.example/", "https://home.example/deep/page", "https://home.example?x=1")
    return table(spark, sf_dir, "pages").select("page_id", c.alias("canonical_all"), X.canonical_filter(c, F.col("url")).alias("canonical"))


@query("""
WITH t AS (SELECT page_id, [404, 403, 429, 503, 418, 410][CAST(page_id % 6 + 1 AS INT)] AS s, regexp_replace(url, '#.*$', '') AS u, page_id % 3 = 0 AS said FROM pages),
h AS (SELECT *, CASE WHEN s IN (404, 410) THEN 'the page may have been removed or is not public' WHEN s = 403 THEN 'the site refused access; it may block automated clients or need a login'
  WHEN s = 429 THEN 'rate limited; try again later' WHEN s = 503 THEN 'the site had a server error' END AS hint FROM t)
SELECT page_id, 'HTTP ' || s || ' for ' || u || CASE WHEN hint IS NULL AND NOT said THEN '' ELSE ': ' || concat_ws('; ', hint, CASE WHEN said THEN 'the site said: no' END) END AS message FROM h
""")
def failure_messages(spark, sf_dir):
    n = F.col("page_id")
    status = pick(n, *map(F.lit, (404, 403, 429, 503, 418, 410)))
    return table(spark, sf_dir, "pages").select("page_id", X.failure_message(status, F.regexp_replace("url", "#.*$", ""), F.when(n % 3 == 0, "no")).alias("message"))


@query("""
WITH t AS (SELECT event_id, event_id % 2 = 0 AS private, event_id % 3 = 0 AS cred, event_id % 5 = 0 AS learnt, event_id % 7 = 0 AS fall, event_id % 11 <> 0 AS remote,
  event_id % 13 = 0 AS listed, event_id % 17 = 0 AS preferred, event_id % 19 <> 0 AS policy, event_id % 9 AS hops FROM events),
l AS (SELECT *, CASE WHEN learnt THEN ['playwright'] WHEN fall THEN ['playwright', 'static'] ELSE ['static', 'playwright'] END AS local FROM t),
o AS (SELECT *, CASE WHEN private THEN local WHEN listed THEN ['jina', 'static'] WHEN preferred THEN ['jina', 'static', 'playwright', 'defuddle', 'cloudflare']
  WHEN NOT policy THEN ['static', 'playwright', 'defuddle', 'jina', 'cloudflare'] ELSE list_concat(local, ['defuddle', 'jina', 'cloudflare']) END AS steps FROM l),
c AS (SELECT *, list_slice(steps, 1, greatest(1, least(hops, 6))) AS cut FROM o),
w AS (SELECT *, list_filter(cut, lambda s: s NOT IN ('defuddle', 'jina', 'cloudflare')) AS own FROM c)
SELECT event_id, CASE WHEN private OR cred OR NOT remote THEN CASE WHEN len(own) > 0 THEN own ELSE local END ELSE cut END AS strategies FROM w
""")
def strategy_orders(spark, sf_dir):
    """All rules of the order in which an address is tried; events stand in for addresses with their facts."""
    n = F.col("event_id")
    listed = F.when(n % 13 == 0, F.array(F.lit("jina"), F.lit("unknown"), F.lit("static"))).otherwise(F.array().cast("array<string>"))
    order = X.strategy_order(n % 2 == 0, n % 3 == 0, n % 5 == 0, n % 7 == 0, n % 11 != 0, listed, F.when(n % 17 == 0, "jina").otherwise(""), n % 19 != 0, (n % 9).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", order.alias("strategies"))


@query("""SELECT o_orderkey, coalesce(CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, CASE o_orderkey % 5 WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true END, CASE o_orderkey % 2 WHEN 0 THEN true END, false) AS llm,
  coalesce(CASE o_orderkey % 5 WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true END, CASE o_orderkey % 2 WHEN 0 THEN true END, false) AS screenshot FROM orders""")
def resolved_options(spark, sf_dir):
    n, none = F.col("o_orderkey"), F.lit(None).cast("boolean")
    explicit, config = pick(n, F.lit(True), F.lit(False), none), pick(n, F.lit(True), none)
    preset = pick(n, F.lit(None).cast("string"), "Minimal", "standard", "RICH", "unknown")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", X.resolved_option("llm", explicit, preset, config).alias("llm"), X.resolved_option("screenshot", none, preset, config).alias("screenshot")
    )


@query("""SELECT p_partkey, p_partkey % 4 IN (0, 1) AND p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AS nothing FROM part""")
def image_only_inputs(spark, sf_dir):
    n = F.col("p_partkey")
    path = F.concat(pick(n, "a/", "b/", "https://ex.com/", "c/"), "p_name", pick(n, ".PNG", ".jpeg", ".png", ".docx"))
    images = routing.READERS["image"].split()
    return table(spark, sf_dir, "part").select("p_partkey", X.publishes_nothing(path, n % 3 != 0, n % 5 == 0, images).alias("nothing"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS error, CASE WHEN o_orderkey % 2 = 1 THEN 'LLM enhancement failed; base Markdown retained: ' || o_orderpriority END AS warning FROM orders""")
def failure_policies(spark, sf_dir):
    p = X.after_failure(F.when(F.col("o_orderkey") % 2 == 0, "fail").otherwise("fallback"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.error", "p.warning")


@query("""
WITH s AS (SELECT o_custkey AS run, o_orderpriority AS key, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2),
n AS (SELECT o_custkey AS run, o_orderpriority AS key, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1, 2)
SELECT coalesce(s.run, n.run) AS run, coalesce(s.key, n.key) AS option, coalesce(s.key, n.key) || ' (saved ' || coalesce(CAST(s.v AS VARCHAR), 'unset') || ', now ' || coalesce(CAST(n.v AS VARCHAR), 'unset') || ')' AS difference
FROM s FULL JOIN n ON s.run = n.run AND s.key = n.key WHERE s.v IS DISTINCT FROM n.v AND coalesce(s.key, n.key) <> '1-URGENT'
""")
def option_changes(spark, sf_dir):
    """Orders' priorities stand in for options of a run, saved and now; one of them does not count."""
    orders = table(spark, sf_dir, "orders")
    side = lambda k: orders.filter(F.col("o_orderkey") % 3 != k).groupBy(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("option")).agg(F.max("o_orderkey").cast("string").alias("value"))
    return runs.option_differences(side(0), side(1), ["run"], ("1-URGENT",))


@query("""SELECT c_nationkey AS batch, count(*) AS items, CAST(sum(o_custkey) AS BIGINT) AS input_tokens, CAST(sum(o_orderkey) AS BIGINT) AS output_tokens FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def usage_of_runs(spark, sf_dir):
    """Orders stand in for items of URL lists: only the completed ones count."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    items = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    items = items.select(F.col("c_nationkey").alias("batch"), status.alias("status"), F.col("o_custkey").alias("input_tokens"), F.col("o_orderkey").alias("output_tokens"))
    return runs.usage_block(items, "batch", url_list=True)


@query("""
WITH t AS (SELECT page_id, url, row_number() OVER (PARTITION BY lower(regexp_replace(url, '[?#].*$', '')) ORDER BY url, page_id) AS k FROM pages)
SELECT page_id, CAST(row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]*)', 1) ORDER BY url, page_id) AS INT) AS place FROM t WHERE k = 1
""")
def task_order(spark, sf_dir):
    """Addresses in the order in which they are shown, host by host, each once."""
    pages_ = table(spark, sf_dir, "pages")
    key, group = F.lower(F.regexp_replace("url", "[?#].*$", "")), F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    return runs.task_order(pages_.withColumn("group", group), "group", key, ["url", "page_id"]).select("page_id", "place")


@query("""SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS number FROM conversations WHERE role <> 'user'""")
def attachment_numbers(spark, sf_dir):
    """Turns that are not the user's stand in for a mail's attachments."""
    parts = table(spark, sf_dir, "conversations").filter("role <> 'user'")
    return runs.numbered(parts, "conv_id", "turn").select("conv_id", "turn", "number")


@query("""
WITH p AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN turn || ' | **Annual report of ' || conv_id || ' things**' WHEN conv_id % 3 = 1 THEN '# Head' ELSE 'short' END AS block FROM conversations),
n AS (SELECT conv_id, count(*) AS pages FROM p GROUP BY 1)
SELECT p.conv_id, p.turn, 'Annual report of ' || p.conv_id || ' things' AS header FROM p JOIN n USING (conv_id) WHERE conv_id % 3 = 0 AND pages >= 3
""")
def running_headers(spark, sf_dir):
    """Turns stand in for pages; a third of the conversations has a header over every page."""
    n, t = F.col("conv_id"), F.col("turn").cast("string")
    block = F.when(n % 3 == 0, F.concat(t, F.lit(" | **Annual report of "), n.cast("string"), F.lit(" things**"))).when(n % 3 == 1, "# Head").otherwise("short")
    turns = table(spark, sf_dir, "conversations").withColumn("md", F.concat(block, F.lit("\n\n"), "text"))
    return P.running_headers(turns, "conv_id", "turn", "md")


@query("""SELECT lang, median(length(text)) AS median, quantile_cont(length(text), 0.9) AS p90, quantile_cont(length(text), 0.95) AS p95 FROM documents GROUP BY lang""")
def layout_percentiles(spark, sf_dir):
    """Lengths of documents stand in for heights and gaps of a layout."""
    return P.layout_percentiles(table(spark, sf_dir, "documents").withColumn("size", F.length("text")), "lang", "size")


@query("""SELECT p_brand AS asset, CASE WHEN count(*) FILTER (p_partkey % 2 = 1) > 0 THEN max(p_name) FILTER (p_partkey % 2 = 1) ELSE max(p_name) END AS alt FROM part GROUP BY 1""")
def image_lists(spark, sf_dir):
    """Brands stand in for assets, parts' names for their descriptions before and after a run."""
    part = table(spark, sf_dir, "part")
    side = lambda k: part.filter(F.col("p_partkey") % 2 == k).groupBy(F.col("p_brand").alias("asset")).agg(F.max("p_name").alias("alt"))
    return render.merge_images(side(0), side(1))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/next?p=' || page_id WHEN 1 THEN 'https://ex.com/' || page_id END AS target FROM pages""")
def refresh_targets(spark, sf_dir):
    """Pages that send on at once, and some that wait too long for that."""
    n, s = F.col("page_id"), F.col("page_id").cast("string")
    tag = pick(n, F.concat(F.lit('<META http-equiv="refresh" content="0; url=/next?p='), s, F.lit('">')), F.concat(F.lit("<meta http-equiv=refresh content='1;URL=https://ex.com/"), s, F.lit("'>")), '<meta http-equiv="refresh" content="30; url=/x">')
    return table(spark, sf_dir, "pages").select("page_id", U.meta_refresh(F.concat(tag, "html")).alias("target"))


USAGE = "SELECT event_type AS model, count(*) AS requests, CAST(sum(user_id) AS BIGINT) AS input_tokens, CAST(sum(event_id) AS BIGINT) AS output_tokens FROM events"


@query(f"""WITH a AS ({USAGE} GROUP BY 1), b AS ({USAGE} WHERE event_id % 4 = 0 GROUP BY 1)
SELECT a.model, a.requests - coalesce(b.requests, 0) AS requests, a.input_tokens - coalesce(b.input_tokens, 0) AS input_tokens, a.output_tokens - coalesce(b.output_tokens, 0) AS output_tokens FROM a LEFT JOIN b USING (model)""")
def usage_added(spark, sf_dir):
    """Events stand in for requests: what was added to the ledger of every fourth."""
    events = table(spark, sf_dir, "events")
    ledger = lambda e: usage.merge_usage(e.select(F.col("event_type").alias("model"), F.lit(1).alias("requests"), F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"), F.lit(None).alias("cost_usd")))
    return usage.usage_difference(ledger(events), ledger(events.filter("event_id % 4 = 0")))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (event_id % 3 = 0) = 0 THEN 'complete' WHEN count(*) FILTER (event_id % 3 <> 0) > 0 THEN 'partial' ELSE 'unknown' END AS status FROM events GROUP BY 1""")
def cost_states(spark, sf_dir):
    """Every third event stands in for a request without a price."""
    cost = F.when(F.col("event_id") % 3 != 0, F.lit(1))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("model"), F.lit(1).alias("requests"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), cost.alias("cost_usd"))
    return usage.merge_usage(rows).select(F.col("model").alias("user_id"), usage.cost_status(F.col("priced_requests"), F.col("unpriced_requests")).alias("status"))


@query("""
SELECT conv_id, CAST(sum(length(text) + 1) AS BIGINT) AS characters, count(*) AS parts, count(*) AS rag FROM conversations WHERE NOT contains(text, '<!--') GROUP BY 1
""")
def marked_pages(spark, sf_dir):
    """Turns stand in for pages: with markers, without them, in parts, and with the markers of a chunker."""
    turns = table(spark, sf_dir, "conversations").filter(~F.contains("text", F.lit("<!--")))
    md = F.concat(F.lit("<!-- Page number: "), F.col("turn").cast("string"), F.lit(" -->\n"), "text", F.lit("\n"))
    pages_ = turns.select("conv_id", md.alias("md"))
    one = pages_.select(
        "conv_id", F.length(rewriting.without_page_markers(F.col("md"))).alias("n"), (F.size(M.page_parts(F.col("md"))) - 1).alias("parts"),
        F.regexp_count(rewriting.rag_markers(F.col("md")), F.lit("<!-- page: [0-9]+ -->")).alias("rag"),
    )
    return one.groupBy("conv_id").agg(F.sum("n").alias("characters"), F.sum("parts").alias("parts"), F.sum("rag").alias("rag"))


MENU = "list_transform(regexp_extract_all(html, '<li><a href=\"/[^\"]*\">([^<]*)</a>', 1), lambda w: regexp_replace(w, '[^\\p{L}]', '', 'g'))"


def _menu():
    """The words of a page's menu, letters only."""
    return F.transform(F.regexp_extract_all("html", F.lit('<li><a href="/[^"]*">([^<]*)</a>'), F.lit(1)), lambda w: F.regexp_replace(w, "[^\\p{L}]", ""))


@query(f"""
WITH p AS (SELECT page_id, {MENU} AS w FROM pages),
i AS (SELECT page_id, list_transform(w, lambda x: CASE WHEN x = '' THEN '![m](assets/)' ELSE '![[assets/' || x || ']]' END) AS made,
  list_transform(w, lambda x: '`![m](assets/' || x || ')` ![m](other/' || x || ')') AS kept FROM p)
SELECT page_id, array_to_string(made, ' ') || ' ' || array_to_string(kept, ' ') AS obsidian FROM i
""")
def obsidian_documents(spark, sf_dir):
    """Images named by a page's menu: shown ones become embeds, those in code or elsewhere stay."""
    images = F.array_join(F.transform(_menu(), lambda w: F.concat(F.lit("![m](.data/assets/"), w, F.lit(")"))), " ")
    others = F.array_join(F.transform(_menu(), lambda w: F.concat(F.lit("`![m](assets/"), w, F.lit(")` ![m](other/"), w, F.lit(")"))), " ")
    return table(spark, sf_dir, "pages").select("page_id", rewriting.obsidian_images(F.concat(images, F.lit(" "), others)).alias("obsidian"))


_FORMS = ("See [a](", ") and `[a](assets/", ")`.\n\n[r]: ", "\n\n![[", '|x]]\n\n<img src="', '" srcset="', " 1x, ", ' 2x">\n\n<style>p{background:url(', ")}</style>\n\n```\n[a](assets/", ")\n```\n")
_AT = (1, None, 2, 3, 4, 5, 6, 1, None)  # the word that stands behind each piece; None: the first or second word, in code


@query(f"""
WITH p AS (SELECT page_id, {MENU} AS w FROM pages),
m AS (SELECT DISTINCT x FROM (SELECT unnest(w) AS x FROM p) WHERE x <> '' AND length(x) % 2 = 0),
t AS (SELECT page_id, list(CASE WHEN m.x IS NULL THEN 'assets/' || p.x ELSE 'files/' || md5(p.x) END ORDER BY k) AS n, list(p.x ORDER BY k) AS w
  FROM (SELECT page_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM p) p LEFT JOIN m ON m.x = p.x GROUP BY 1)
SELECT page_id, 'See [a](' || n[1] || ') and `[a](assets/' || w[1] || ')`.' || chr(10) || chr(10) || '[r]: ' || n[2] || chr(10) || chr(10) || '![[' || n[3] || '|x]]' || chr(10) || chr(10) || '<img src="' || n[4]
  || '" srcset="' || n[5] || ' 1x, ' || n[6] || ' 2x">' || chr(10) || chr(10) || '<style>p{{background:url(' || n[1] || ')}}</style>' || chr(10) || chr(10) || '```' || chr(10) || '[a](assets/' || w[2] || ')' || chr(10) || '```' || chr(10) AS text
FROM t WHERE len(w) >= 6
""")
def moved_references(spark, sf_dir):
    """Documents that name a page's menu words as files in all forms; files whose names have an even length have moved."""
    pages = table(spark, sf_dir, "pages").select("page_id", _menu().alias("w")).filter(F.size("w") >= 6)
    word = lambda k: F.element_at("w", k)
    behind = [F.concat(F.lit("assets/"), word(k)) if k else word(1 if n < 5 else 2) for n, k in enumerate(_AT)]
    docs = pages.select("page_id", F.concat(F.lit(_FORMS[0]), *[c for piece, w in zip(_FORMS[1:], behind) for c in (w, F.lit(piece))]).alias("text"))
    known = pages.select(F.explode("w").alias("x")).filter("x <> '' AND length(x) % 2 = 0").distinct()
    moved = known.select(F.concat(F.lit("assets/"), "x").alias("target"), F.concat(F.lit("files/"), F.md5("x")).alias("path"))
    return rewriting.rewritten(docs, "page_id", "text", moved)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Note' ELSE 'Document' END AS type, p_name AS resource, 'quillflow 2024-01-02T03:04:05Z' AS generated FROM part""")
def knowledge_metadata(spark, sf_dir):
    """Metadata in the open knowledge form, applied twice."""
    own = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("source"), F.col("p_name"), F.lit("type"), F.lit("Note"))).otherwise(F.create_map(F.lit("source"), F.col("p_name")))
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    once = table(spark, sf_dir, "part").select("p_partkey", render.okf(own, "quillflow", at).alias("m"))
    return once.select("p_partkey", render.okf(F.col("m"), "other", at).alias("m")).select("p_partkey", *[F.col("m")[k].alias(k) for k in ("type", "resource", "generated")])


@query("""SELECT event_id, event_type || chr(10) || '100%' AS shown FROM events""")
def terminal_texts(spark, sf_dir):
    """Printed text with colours, and a progress line that overwrites itself."""
    raw = F.concat(F.lit("\x1b[1;31m"), "event_type", F.lit("\x1b[0m\r\n 50%\r100%"))
    clean = F.udf(plain.terminal_text, useArrow=True)
    return table(spark, sf_dir, "events").select("event_id", clean(raw).alias("shown"))


@query("""SELECT page_id, regexp_matches(url, '^https?://(?:[^/?#]*\\.)?example\\.(?:com|net)(?:[/?#:]|$)') AS fallback FROM pages""")
def fallback_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.fallback_domain(F.col("url"), ["example.com", "example.net"]).alias("fallback"))


@query("""
SELECT page_id, regexp_matches(lower(url), '^https?://[^/?#]*example\\.net(?:[/?#]|$)') OR regexp_matches(url, '^https?://[^?#]*/[0-9]+[05]/?(?:[?#]|$)') OR lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) LIKE 'm.%' AS bypass FROM pages
""")
def cache_bypasses(spark, sf_dir):
    """Addresses that a cache passes over: by whole address, by last segment, and by host."""
    patterns = ["*://*EXAMPLE.net", "*://*example.net/*", "*example.net[?#]*", "**/*[0-9][05]", "m.*", " "]
    return table(spark, sf_dir, "pages").select("page_id", U.matches_patterns(F.col("url"), patterns).alias("bypass"))


@query("""
WITH h AS (SELECT event_id, 'https://' || CASE event_id % 7 WHEN 0 THEN '10.' || event_id % 256 || '.3.4' WHEN 1 THEN 'Example.com' WHEN 2 THEN 'a.example.com' WHEN 3 THEN '192.168.' || event_id % 9 || '.1' WHEN 4 THEN 'corp.example' WHEN 5 THEN 'x.corp.example.' ELSE '300.1.1.1' END AS url FROM events)
SELECT event_id, event_id % 7 = 2 OR event_id % 7 = 4 OR (event_id % 7 = 0 AND event_id % 256 BETWEEN 16 AND 31) OR (event_id % 7 = 3 AND event_id % 9 IN (4, 5)) AS bypass FROM h
""")
def proxy_bypasses(spark, sf_dir):
    """Events stand in for requests, with names and addresses as hosts."""
    n = F.col("event_id")
    s = lambda x: x.cast("string")
    h = pick(n, F.concat(F.lit("10."), s(n % 256), F.lit(".3.4")), "Example.com", "a.example.com", F.concat(F.lit("192.168."), s(n % 9), F.lit(".1")), "corp.example", "x.corp.example.", "300.1.1.1")
    url = F.concat(F.lit("https://"), h, F.lit(":8443/p?q=1"))
    rules = [".example.com", "10.16.0.0/12", "192.168.4.0/255.255.254.0", "CORP.example", "host:80", "<local>", "10.0.0.0/40"]
    return table(spark, sf_dir, "events").select("event_id", U.bypasses_proxy(url, rules).alias("bypass"))


@query("""
WITH p AS (SELECT conv_id, turn, conv_id % 3 AS k, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)
SELECT conv_id, turn, CASE WHEN k = 0 THEN first ELSE before END AS owner, ['|' || turn || '|x|', '|b|y|'] AS rows FROM p WHERE k < 2 AND before IS NOT NULL
""")
def table_continuations(spark, sf_dir):
    """Turns stand in for pages: a table over whole pages, one that begins and ends amid other text, and tables of another header."""
    t, k = F.col("turn").cast("string"), F.col("conv_id") % 3
    head = F.when(k == 2, F.concat(F.lit("|Name|"), t, F.lit("|\n|---|---|\n|"))).otherwise("|Name|Count|\n|---|---|\n|")
    part = F.concat(head, t, F.lit("|x|\n|b|y|"))
    last = F.concat(head, F.lit("z|z|"))
    page = F.when(k == 1, F.concat(part, F.lit("\n\nSome text.\n\n"), last)).otherwise(part)
    return P.continued_tables(table(spark, sf_dir, "conversations").withColumn("md", page), "conv_id", "turn", "md")
