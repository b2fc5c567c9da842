"""Text measures and spellings as Spark columns. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Scripts that count one word a character, and what may stand in any other word.
CJK = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}]"
WORD = "[\\p{L}\\p{N}_]+"


def word_count(text: Column) -> Column:
    """Words: every CJK character is one, elsewhere runs of letters, digits and underscores."""
    plain = F.regexp_replace(text, CJK, " ")
    return (F.regexp_count(text, F.lit(CJK)) + F.regexp_count(plain, F.lit(WORD))).cast("long")


def token_estimate(text: Column) -> Column:
    """Cautious token count: two fifths for an ASCII character, one for any other, rounded up."""
    ascii_ = F.length(F.regexp_replace(text, "[^\\x00-\\x7F]", ""))
    fifths = 2 * ascii_ + 5 * (F.length(text) - ascii_)
    return F.floor((fifths + 4) / F.lit(5)).cast("long")


def bigrams(text: Column, width: int = 2) -> Column:
    """Distinct character n-grams of the text without white space."""
    chars = F.filter(F.split(F.regexp_replace(text, "\\s", ""), ""), lambda c: c != "")
    grams = chars
    for k in range(1, width):
        after = F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0)))
        grams = F.zip_with(grams, after, lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(grams, lambda g: g.isNotNull()))


def plausible(source: Column, answer: Column) -> Column:
    """Whether an answer keeps enough of its source to be a clean-up of it: short sources always do; else it has a fifth
    of the length and three tenths of the source's character pairs."""
    solid = lambda c: F.length(F.regexp_replace(c, "\\s", ""))
    a, b = bigrams(source), bigrams(answer)
    shared = F.size(F.array_intersect(a, b))
    return (solid(source) < 200) | ((solid(answer) * 5 >= solid(source)) & (shared * 10 >= F.size(a) * 3))


def fence(text: Column) -> Column:
    """A code fence longer than any run of backticks in the text, three at least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def preview(text: Column, limit: int = 40_000, head: int = 2_000) -> Column:
    """Long bodies are replaced by their head."""
    return F.when(F.length(text) > limit, F.substring(text, 1, head)).otherwise(text)


def table_cell(text: Column) -> Column:
    """A pipe-table cell: pipes escaped, line breaks spelt out."""
    return F.regexp_replace(F.regexp_replace(text, "\\|", "\\\\|"), "\r\n|\r|\n", "<br>")


def plain_title(text: Column) -> Column:
    """A heading as a title: links keep their text, inline tags, emphasis and escapes go, white space collapses."""
    out = F.regexp_replace(F.trim(F.regexp_replace(text, "\\s+", " ")), "^#{1,6}\\s+", "")
    out = F.regexp_replace(out, "!?\\[([^\\]]*)\\]\\([^)]+\\)", "$1")
    out = F.regexp_replace(out, "(?i)</?(?:strong|em|b|i|code)>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "\\*\\*", ""), "\\\\([!-/:-@\\[-`{-~])", "$1"))


def title_of(text: Column, fallback: Column) -> Column:
    """First heading that is not empty, else the fallback."""
    heads = F.transform(F.regexp_extract_all(text, F.lit("(?m)^(# .*|##.*)$"), 1), lambda h: plain_title(F.regexp_replace(h, "^#+", "")))
    return F.coalesce(F.get(F.filter(heads, lambda h: h != ""), F.lit(0)), fallback)


def byte_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024.0, 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(n / 1048576.0, 1)))
    )


def duration(seconds: Column) -> Column:
    """1.2s below a minute, MM:SS below an hour, HH:MM:SS beyond."""
    whole = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, s = F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60
    return (
        F.when(seconds < 60, F.format_string("%.1fs", F.bround(seconds.cast("double"), 1)))
        .when(whole < 3600, F.concat_ws(":", two(m), two(s)))
        .otherwise(F.concat_ws(":", two(h), two(m), two(s)))
    )


#: Plain scalars that a YAML 1.1 loader would not read as a string.
YAML_NOT_TEXT = (
    "^(?:yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF"
    "|[-+]?(?:[0-9][0-9_]*)\\.[0-9_]*(?:[eE][-+][0-9]+)?|\\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?"
    "|[-+]?[0-9][0-9_]*(?::[0-5]?[0-9])+\\.[0-9_]*|[-+]?\\.(?:inf|Inf|INF)|\\.(?:nan|NaN|NAN)"
    "|[-+]?0b[0-1_]+|[-+]?0[0-7_]+|[-+]?(?:0|[1-9][0-9_]*)|[-+]?0x[0-9a-fA-F_]+"
    "|[-+]?[1-9][0-9_]*(?::[0-5]?[0-9])+|~|null|Null|NULL|<<|="
    "|[0-9]{4}-[0-9]{2}-[0-9]{2}"
    "|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt]|[ \\t]+)[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\\.[0-9]*)?"
    "(?:[ \\t]*(?:Z|[-+][0-9]{1,2}(?::[0-9]{2})?))?)$"
)


def yaml_scalar(text: Column) -> Column:
    """A string as a YAML scalar that every loader reads as a string; plain where it can be."""
    risky = (text == "") | text.rlike(YAML_NOT_TEXT)
    special = text.rlike("^[\\s\\-?:,\\[\\]{}#&*!|>'\"%@`]|: |:$| #|\\s$")
    return F.when(risky | special, F.concat(F.lit("'"), F.regexp_replace(text, "'", "''"), F.lit("'"))).otherwise(text)


def description(text: Column) -> Column:
    """Collapsed; beyond 150 characters the first 147 and an ellipsis."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(flat) > 150, F.concat(F.substring(flat, 1, 147), F.lit("..."))).otherwise(flat)


def tag(text: Column) -> Column:
    """A tag: quotes go, white space and colons become hyphens, 30 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(text), "[\"']", ""), "[\\s:]+", "-"), 1, 30)


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text).cast("double")
    count = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda s, c: s - count(c) * F.log2(count(c)))


#: Device names that no file may have, and the bytes of a name.
DEVICES = "(?i)^(?:con|prn|aux|nul|conin\\$|conout\\$|(?:com|lpt)[0-9¹²³]) *(?:\\.|$)"
NAME_BYTES = 180


def left_bytes(text: Column, n: Column) -> Column:
    """The longest beginning of a text that has at most n bytes in UTF-8."""
    cut = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), n), "UTF-8")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(cut, "\ufffd+$", ""))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it stands in the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def file_name(text: Column, fallback: str = "unnamed") -> Column:
    """One safe file name: reserved characters become underscores, outer spaces and dots go, devices get a prefix, and
    what is longer than 180 bytes of UTF-8 is cut before its extension."""

    def shortened(name: Column) -> Column:
        ext = F.regexp_extract(name, "^.+(\\.[^.]{1,89})$", 1)
        stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
        cut = F.concat(left_bytes(stem, F.lit(NAME_BYTES) - F.octet_length(ext)), ext)
        return F.when(F.octet_length(name) > NAME_BYTES, F.regexp_replace(cut, "[ .]+$", "")).otherwise(name)

    clean = F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x1F\\x7F-\\x9F<>:\"/\\\\|?*]", "_"), "^[ .]+|[ .]+$", "")
    clean = F.coalesce(F.nullif(clean, F.lit("")), F.when(text.isNotNull(), F.lit(fallback)))
    clean = let(clean, lambda c: F.when(c.rlike(DEVICES), F.concat(F.lit("_"), c)).otherwise(c))
    return let(clean, shortened)
