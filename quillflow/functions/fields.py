"""Small fields of documents, mail, caches and fetching as Spark columns: dates, numbers, labels, keys and messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .urls import host, redact

#: The scripts of which a character is a unit of its own.
EAST_ASIAN = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{323AF}]"


# --- text -------------------------------------------------------------------------------------------------------


def text_units(text: Column) -> Column:
    """East Asian characters, and runs of other letters and digits."""
    rest = F.regexp_replace(text, EAST_ASIAN, " ")
    return (F.regexp_count(text, F.lit(EAST_ASIAN)) + F.regexp_count(rest, F.lit("[\\p{L}\\p{N}]+"))).cast("long")


def split_front_matter(text: Column) -> Column:
    """struct<front, body>: the YAML between a first line `---` and the next one, if every line at its margin is a key, a
    comment, an item of the key before, or blank; else front is null and the body the whole text. The body loses its leading line feeds."""
    whole = "^---\\n((?s:.*?)(?<=\\n))---(?:\\n|$)"
    front = F.when(text.rlike(whole), F.regexp_extract(text, whole, 1))
    mapping = ~front.rlike("(?m)^(?!(?:[^\\s#:\\-\\[{][^:\\n]*:(?:[ \\t].*)?|[\\s#].*|- .*|)$)") & front.rlike("(?m)^[^\\s#:\\-\\[{][^:\\n]*:(?:[ \\t]|$)")
    is_front = F.coalesce(mapping, F.lit(False))
    body = F.regexp_replace(F.regexp_replace(text, whole, ""), "^\\n+", "")
    return F.struct(F.when(is_front, front).alias("front"), F.when(is_front, body).otherwise(text).alias("body"))


def safe_header(text: Column) -> Column:
    """A mail header's value on one line that cannot open HTML."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, "\\p{Cc}", " "), "\\s+", " "))
    return F.regexp_replace(flat, "([<>])", "\\\\$1")


def link_label(text: Column) -> Column:
    """A text that is safe within [...]."""
    return F.regexp_replace(safe_header(F.regexp_replace(text, "\\\\", "\\\\\\\\")), "[\\[\\]()]", "_")


def without_soft_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, "\\x{AD}", "")


def bare_json(text: Column) -> Column:
    """The JSON of an answer that may stand in a code fence."""
    flat = F.regexp_replace(text, "^\\s+|\\s+$", "")
    fenced = F.regexp_extract(flat, "^```(?:json)?\\n((?s).*)```$", 1)
    return F.when(flat.rlike("^```(?:json)?\\n(?s:.*)```$"), F.regexp_replace(fenced, "^\\s+|\\s+$", "")).otherwise(flat)


def repaired_json(text: Column) -> Column:
    """The JSON without commas right before a closing bracket; null where nothing had to go, beyond 1 MiB, or if it is still
    no JSON. No quote, bracket, key or value is ever made up."""
    bare = bare_json(text)
    out = F.regexp_replace(bare, '("(?:[^"\\\\]|\\\\(?s:.))*+")|,([ \\t\\n\\r\\f]*[}\\]])', "$1$2")
    usable = (out != bare) & (F.octet_length(bare) <= 1 << 20) & F.try_parse_json(out).isNotNull()
    return F.when(usable, out)


def label_words(text: Column) -> Column:
    """A short label's words in lower case; letters and digits are split, numbers keep their separators."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([0-9][0-9.,]*|[\\p{L}\\p{N}&&[^0-9]]+)"), 1)
    return F.filter(F.transform(found, lambda w: F.regexp_replace(w, "[.,]+$", "")), lambda w: w != "")


def is_reading_time(text: Column) -> Column:
    words, unit = F.array_join(label_words(text), " "), "(?:mins?|minutes?)"
    return words.rlike(f"^(?:[0-9]{{1,3}} {unit} (?:read|reading)|(?:reading|read) time [0-9]{{1,3}} {unit})$")


def is_counter(text: Column) -> Column:
    return F.array_join(label_words(text), " ").rlike("^[0-9.,]+ (?:[km] )?(?:likes?|views?|shares?|comments?)$")


def image_references(text: Column) -> Column:
    """array<struct<alt, target>> of inline images outside code, in order."""
    prose = F.regexp_replace(text, "(?ms)^ {0,3}(`{3,}|~{3,})[^\\n]*\\n.*?^ {0,3}\\1[`~]*[ \\t]*$|(?<!`)(`+)(?!`)[^\\n]*?(?<!`)\\2(?!`)", "")
    found = F.regexp_extract_all(prose, F.lit("(!\\[[^\\]\\n]*\\]\\(<?[^)\\s>]+>?(?:\\s+\"[^\"\\n]*\")?\\))"), 1)
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, "^!\\[([^\\]]*)\\]", 1).alias("alt"), F.regexp_extract(m, "\\]\\(<?([^)\\s>]+)", 1).alias("target")))


# --- dates and numbers ------------------------------------------------------------------------------------------


def iso_from_unix(value: Column) -> Column:
    """Unix seconds, or milliseconds beyond 10^11, as ISO 8601 in UTC+8."""
    seconds = F.when(value > 100_000_000_000, F.floor(value / 1000)).otherwise(value).cast("long")
    at = F.timestamp_seconds(seconds + 8 * 3600)
    return F.concat(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))


def iso_from_text(text: Column) -> Column:
    """A date that a page shows, with or without a time, as ISO 8601 in UTC+8; null where there is none."""
    pattern = "([0-9]{4})[^0-9]{1,2}([0-9]{1,2})[^0-9]{1,2}([0-9]{1,2})[^0-9]{0,2}(?:([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?"
    part = lambda k: F.lpad(F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), F.lit("0")), 2, "0")
    year, month, day = F.regexp_extract(text, pattern, 1), part(2), part(3)
    sound = (year >= "1990") & (year <= "2100") & (month >= "01") & (month <= "12") & (day >= "01") & (day <= "31")
    return F.when(text.rlike(pattern) & sound, F.concat(F.concat_ws("-", year, month, day), F.lit("T"), F.concat_ws(":", part(4), part(5), part(6)), F.lit("+08:00")))


def pdf_date(text: Column) -> Column:
    """A PDF date such as D:20170816144228+02'00' as RFC 3339, or its day alone where it has no time; null if it is none."""
    pattern = "^(?:D:)?([0-9]{4})(?:([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})([0-9]{2})?)?)?)?)?(?![0-9])"
    part = lambda k, default: F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), F.lit(default))
    day = F.concat_ws("-", part(1, "x"), part(2, "01"), part(3, "01"))
    hour, minute, second = part(4, "00"), part(5, "00"), part(6, "00")
    zone = F.regexp_extract(text, "^(?:D:)?[0-9]+(.?)", 1)
    two = "^(?:D:)?[0-9]+[+-][^0-9]*([0-9]{2})[^0-9]*([0-9]{2})?"
    hours, minutes = F.regexp_extract(text, two, 1), F.coalesce(F.nullif(F.regexp_extract(text, two, 2), F.lit("")), F.lit("00"))
    offset = F.when(zone == "Z", "Z").when(zone.isin("+", "-"), F.when((hours != "") & (hours <= "23") & (minutes <= "59"), F.concat(zone, hours, F.lit(":"), minutes))).otherwise("Z")
    sound = text.rlike(pattern) & F.try_to_date(day, "yyyy-MM-dd").isNotNull() & (hour <= "23") & (minute <= "59") & (second <= "60")
    time = F.concat(day, F.lit("T"), F.concat_ws(":", hour, minute, second), offset)
    return F.when(sound, F.when(F.regexp_extract(text, pattern, 4) == "", day).otherwise(time))


def decimal_text(value: Column, places: int) -> Column:
    """A decimal with a fixed number of places, rounded half away from zero; what rounds to zero has no sign."""
    out = F.round(value.cast(f"decimal(38,{min(places + 8, 18)})"), places).cast(f"decimal(38,{places})").cast("string")
    return F.when(out.rlike("^-[0.]+$"), F.substring(out, 2, 100)).otherwise(out)


# --- keys -------------------------------------------------------------------------------------------------------


def _length_bytes(data: Column) -> Column:
    """A length as eight bytes, the lowest first."""
    digits = F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))


def framed(*parts: Column) -> Column:
    """Parts one after another, each behind its length: no two lists of parts give the same bytes."""
    return F.concat(*[x for p in parts for x in (_length_bytes(p), F.encode(p, "UTF-8"))])


def prompt_scope(*parts: Column) -> Column:
    return F.sha2(framed(*parts), 256)


def vision_key(prompt: Column, models: Column, content: Column) -> Column:
    """Key of a cached answer to a prompt about pages; images are framed into `content` by the caller."""
    return F.substring(F.sha2(framed(F.lit("native-vision-v1"), prompt, models, content), 256), 1, 32)


def model_scope(models: Column) -> Column:
    """Name of a pool of models: a digest of their sorted distinct names."""
    names = F.array_sort(F.array_distinct(F.filter(models, lambda m: m.isNotNull() & (m != ""))))
    return F.when(F.size(names) == 0, "pool:none").otherwise(F.concat(F.lit("pool:"), F.substring(F.sha2(F.array_join(names, "\n"), 256), 1, 16)))


@F.pandas_udf(T.StringType())
def report_hash(source, target, options):
    """Six hex digits that name a run: MD5 of sorted ASCII JSON of its input, output and options (a JSON object of strings,
    whole numbers, booleans, lists and objects)."""
    import hashlib
    import json

    import pandas as pd

    def one(i, o, x):
        if i is None or o is None:
            return None
        return hashlib.md5(json.dumps({"input": i, "options": json.loads(x or "{}"), "output": o}, sort_keys=True).encode()).hexdigest()[:6]

    return pd.Series([one(*row) for row in zip(source, target, options)])


# --- fetching and runs ------------------------------------------------------------------------------------------


def canonical_filter(canonical: Column, url: Column) -> Column:
    """A page's canonical address; null where it names the home page and the page lies deeper."""
    path = lambda u: F.regexp_replace(F.regexp_extract(u, "^(?i:https?)://[^/?#]*([^?#]*)", 1), "/", "")
    return F.when(~((path(url) != "") & (path(canonical) == "")), canonical)


def failure_message(status: Column, url: Column, said: Column) -> Column:
    """What a failed fetch reports: the status, the redacted address, a hint, and what the site said."""
    hint = (
        F.when(status.isin(404, 410), "the page may have been removed or is not public")
        .when(status.isin(401, 403), "the site refused access; it may block automated clients or need a login")
        .when(status == 429, "rate limited; try again later")
        .when(status.between(500, 599), "the site had a server error")
    )
    parts = F.concat_ws("; ", hint, F.concat(F.lit("the site said: "), said))
    return F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" for "), redact(url), F.when(parts != "", F.concat(F.lit(": "), parts)).otherwise(""))


#: Fetch strategies in their usual order, and those that a service runs.
STRATEGIES = ("static", "playwright", "defuddle", "jina", "cloudflare")
REMOTE = STRATEGIES[2:]


def strategy_order(
    restricted: Column, credentialed: Column, learnt: Column, fallback: Column, remote: Column, listed: Column, preferred: Column, policy: Column, hops: Column
) -> Column:
    """Strategies to try for an address, in order.

    A private address is fetched locally. Else a list of its own decides, then a preferred first step, then whether the
    policy is on (off: the usual order). With the policy, a learnt route is the browser's alone, a fallback domain begins with
    the browser, and services follow. At most `hops` steps (1 to 6); none of a service where that is not allowed.
    """
    lit = lambda xs: F.array(*map(F.lit, xs))
    local = F.when(learnt, lit(["playwright"])).when(fallback, lit(["playwright", "static"])).otherwise(lit(["static", "playwright"]))
    known = F.filter(listed, lambda s: s.isin(*STRATEGIES))
    order = (
        F.when(restricted, local).when(F.size(known) > 0, known)
        .when(preferred.isin(*STRATEGIES), F.concat(F.array(preferred), F.array_remove(lit(STRATEGIES), preferred)))
        .when(~policy, lit(STRATEGIES)).otherwise(F.concat(local, lit(REMOTE)))
    )
    cut = F.slice(order, F.lit(1), F.greatest(F.lit(1), F.least(hops, F.lit(6))))
    own = F.filter(cut, lambda s: ~s.isin(*REMOTE))
    return F.when(restricted | credentialed | ~remote, F.when(F.size(own) > 0, own).otherwise(local)).otherwise(cut)


#: The feature switches of the built-in presets.
PRESETS = {"minimal": (False, False, False, False, False), "standard": (True, False, True, True, False), "rich": (True, False, True, True, True)}
FEATURES = ("llm", "ocr", "alt", "desc", "screenshot")


def resolved_option(feature: str, explicit: Column, preset: Column, config: Column) -> Column:
    """A feature switch: as asked for, else as the preset has it, else as configured, else off."""
    known = [F.lit(x) for name, values in PRESETS.items() for x in (name, values[FEATURES.index(feature)])]
    return F.coalesce(explicit, F.try_element_at(F.create_map(*known), F.lower(preset)), config, F.lit(False))


def publishes_nothing(path: Column, llm: Column, ocr: Column, image_extensions: list[str]) -> Column:
    """Whether an input is an image file and nothing may read it."""
    extension = F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))
    return ~path.rlike("(?i)^https?://") & extension.isin(*image_extensions) & ~llm & ~ocr


def after_failure(policy: Column, error: Column) -> Column:
    """What becomes of a document whose enhancement failed: struct<error, warning>. Under `fail` it fails, else its base text
    stays and a warning says so."""
    fails = policy == "fail"
    warning = F.concat(F.lit("LLM enhancement failed; base Markdown retained: "), error)
    return F.struct(F.when(fails, error).alias("error"), F.when(~fails, warning).alias("warning"))


def fallback_domain(url: Column, patterns: list[str]) -> Column:
    """Whether a host is one of the patterns or lies below one."""
    h = host(url)
    return F.exists(F.array(*[(h == p) | h.endswith("." + p) for p in patterns]), lambda x: x)
