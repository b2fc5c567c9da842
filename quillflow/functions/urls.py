"""URL parts, names and redaction as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import entropy, file_name, let

#: Words that make a parameter secret wherever they stand in its name, and whole names or parts that do.
SECRET_ANYWHERE = "token|key|secret|password|signature|credential"
SECRET_WHOLE = "apikey|auth|code|key|pwd|sid|sig|ticket"
SECRET_PART = (
    "assertion|authorization|auth|bearer|credential|credentials|jwt|otp|passcode|passwd|password|pwd|saml|session|secret"
    "|signature|ticket|token"
)
#: Query parameters that name a page itself.
IDENTIFIES = "^(?:id|v|p|pid|tid|nid|aid|vid|(?:story|article|post|topic|thread|item|video|doc)(?:_?id)?|page_?id)$"


def is_url(text: Column) -> Column:
    return text.rlike("(?i)^https?://")


def authority(url: Column) -> Column:
    """Host in lower case, with a port that is not the scheme's own."""
    host = F.lower(F.regexp_extract(url, "^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    port = F.regexp_extract(url, "^(?i:https?)://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)", 1)
    own = F.when(F.lower(url).startswith("https"), "443").otherwise("80")
    return F.when((port == "") | (port == own), host).otherwise(F.concat_ws(":", host, port))


def host(url: Column) -> Column:
    return F.regexp_replace(authority(url), ":[0-9]+$", "")


def query_text(url: Column) -> Column:
    return F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)


def pairs(url: Column) -> Column:
    """Query parameters as array<struct<k, v>>, as written."""
    parts = F.filter(F.split(query_text(url), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")))


def snake(name: Column) -> Column:
    out = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    out = F.regexp_replace(out, "([A-Z])([A-Z][a-z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(out), "[^a-z0-9]+", "_"), "^_|_$", "")


def secret_parameter(name: Column) -> Column:
    """Whether a parameter's name says that its value is a secret."""
    s = snake(name)
    part = s.rlike(f"(?:^|_)(?:{SECRET_PART})(?:_|$)")
    api = s.rlike("(?:^|_)key(?:_|$)") & s.rlike("(?:^|_)(?:api|auth|access)(?:_|$)")
    return F.lower(name).rlike(SECRET_ANYWHERE) | s.rlike(f"^(?:{SECRET_WHOLE})$") | part | api


def form_pairs(text: Column) -> Column:
    """Parameters of a form-encoded text as array<struct<k, v>>, decoded; what does not decode stays as written."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    parts = F.filter(F.split(text, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(plain(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), plain(F.regexp_extract(p, "^[^=]*=((?s).*)$", 1)).alias("v")))


def redacted_form(text: Column) -> Column:
    """A form-encoded text; if one of its parameters is secret, all are encoded anew and the secret values are REDACTED."""
    found = form_pairs(text)
    spelt = F.transform(found, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.when(secret_parameter(p["k"]), F.lit("REDACTED")).otherwise(F.url_encode(p["v"]))))
    return F.when(F.exists(found, lambda p: secret_parameter(p["k"])), F.array_join(spelt, "&")).otherwise(text)


def redact(url: Column) -> Column:
    """Without userinfo, and without the values of secret parameters of the query and of a form-like fragment."""
    bare = F.regexp_replace(url, "^((?i:https?)://)[^/?#@]*@", "$1")
    before, query, fragment = (F.regexp_extract(bare, p, 1) for p in ("^([^?#]*)", "^[^?#]*\\?([^#]*)", "#((?s).*)$"))
    with_query = F.when(bare.rlike("^[^?#]*\\?"), F.concat(F.lit("?"), redacted_form(query))).otherwise("")
    return F.concat(before, with_query, F.when(F.contains(bare, F.lit("#")), F.concat(F.lit("#"), redacted_form(fragment))).otherwise(""))


def output_name(url: Column) -> Column:
    """File name of a page: its last path segment, led by the host where a query says more, with the query's identity."""
    place = F.regexp_replace(F.regexp_replace(authority(url), ":", "_"), "\\.", "_")
    path = F.regexp_extract(url, "^(?i:https?)://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    named = F.filter(pairs(url), lambda p: F.lower(p["k"]).rlike(IDENTIFIES))
    clean = lambda v: F.substring(F.regexp_replace(F.regexp_replace(v, "[^\\p{L}\\p{N}_.]+", "-"), "^[-.]+|[-.]+$", ""), 1, 64)
    identity = F.get(F.filter(F.transform(named, lambda p: clean(p["v"])), lambda v: v != ""), F.lit(0))
    last = F.try_element_at(segments, F.lit(-1))
    known = F.struct(place.alias("place"), last.alias("last"), identity.alias("identity"), (F.instr(url, "?") > 0).alias("queried"))

    def raw(k: Column) -> Column:
        def with_path(decoded: Column) -> Column:
            more = F.when(k["identity"].isNotNull() & ~F.contains(decoded, k["identity"]), k["identity"])
            return F.when(k["queried"], F.concat_ws("_", k["place"], decoded, more)).otherwise(decoded)

        decoded = F.coalesce(F.try_url_decode(F.regexp_replace(k["last"], "\\+", "%2B")), k["last"])
        return F.when(k["last"].isNotNull(), let(decoded, with_path)).otherwise(F.concat_ws("_", k["place"], k["identity"]))

    return let(let(known, raw), lambda name: file_name(name))


def is_opaque(segment: Column) -> Column:
    """Whether a path segment looks like a secret of its own: a JWT, or long, mixed and of high entropy."""
    jwt = segment.rlike("^[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}$")
    shape = (F.length(segment) >= 24) & segment.rlike("^[A-Za-z0-9_~.-]+$") & ~segment.rlike("^[0-9A-Fa-f-]+$")
    mixed = segment.rlike("[a-z]") & segment.rlike("[A-Z]") & segment.rlike("[0-9]")
    varied = F.size(F.array_distinct(F.filter(F.split(segment, ""), lambda c: c != ""))) >= 10
    return jwt | (shape & mixed & varied & (entropy(segment) >= 3.5))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: * and ? stay within a path segment, ** crosses them."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c not in "_/" else c
            k += 1
    return f"^{out}$"


def fnmatch_pattern(glob: str) -> str:
    """A shell pattern as a regular expression; slashes are ordinary characters, braces stand for themselves."""
    out, k = "", 0
    while k < len(glob):
        c, end = glob[k], glob.find("]", k + 2)
        if c == "[" and end > 0:
            own = glob[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, k = out + "[" + ("^" + own[1:] if own[0] == "!" else own) + "]", end
        else:
            out += ".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_/" else "\\" + c
        k += 1
    return f"^(?s:{out})$"


def lower_authority(url: Column) -> Column:
    """An address with its scheme and authority in lower case."""
    head = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.concat(F.lower(head), F.substring(url, F.length(head) + 1, F.length(url)))


def matches_patterns(url: Column, patterns: list[str]) -> Column:
    """Whether a shell pattern matches the address (with or without its scheme), its host with or without the port, or its last
    path segment. A leading `**/` may match nothing."""
    whole = lower_authority(url)
    rest = F.regexp_replace(whole, "^[a-z][a-z0-9+.-]*://", "")
    authority_ = F.regexp_extract(rest, "^([^/?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(authority_, "^.*@", ""), ":[0-9]*$", "")
    path = F.regexp_replace(F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)", 1), "/+$", "")
    last = F.regexp_extract(path, "([^/]*)$", 1)
    found = F.lit(False)
    for pattern in filter(None, map(str.strip, patterns)):
        for variant in {pattern, pattern.removeprefix("**/")}:
            head, sep, tail = variant.partition("://")
            host_end = next((k for k, c in enumerate(tail or head) if c in "/?#"), len(tail or head))
            folded = (head.lower() + sep + tail[:host_end].lower() + tail[host_end:]) if sep else head[:host_end].lower() + head[host_end:]
            found = found | whole.rlike(fnmatch_pattern(folded)) | rest.rlike(fnmatch_pattern(folded))
            found = found | authority_.rlike(fnmatch_pattern(variant.lower())) | name.rlike(fnmatch_pattern(variant.lower())) | last.rlike(fnmatch_pattern(variant))
    return found


def ipv4(text: Column) -> Column:
    """An IPv4 literal as a number; null for anything else."""
    parts = F.transform(F.split(F.when(text.rlike("^[0-9]{1,3}(?:\\.[0-9]{1,3}){3}$"), text), "\\."), lambda p: p.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    return F.when(F.forall(parts, lambda p: p <= 255), number)


def bypasses_proxy(url: Column, rules: list[str]) -> Column:
    """Whether a NO_PROXY list names the address's host: `*` every one, `.name` and `*.name` what is below a name, an IPv4 block
    (a prefix length or a mask) its addresses, and anything else exactly itself. What is no rule is passed over."""
    import ipaddress

    h = F.regexp_replace(host(url), "\\.$", "")
    number, found = ipv4(h), F.lit(False)
    for rule in filter(None, map(str.strip, rules)):
        if rule == "*":
            return F.lit(True)
        if "/" in rule:
            try:
                net = ipaddress.IPv4Network(rule, strict=False)
            except ValueError:
                continue
            found = found | F.coalesce(number.between(int(net.network_address), int(net.broadcast_address)), F.lit(False))
        elif rule.startswith((".", "*.")) and "*" not in rule.removeprefix("*."):
            found = found | h.endswith("." + rule.removeprefix("*.").removeprefix(".").lower())
        elif not set("*:@?#<>%; ") & set(rule):
            found = found | (h == rule.lower().rstrip("."))
    return found


#: Hosts of posts and their mirrors, and names that say a host is local.
POST_HOSTS = "x\\.com|twitter\\.com|fxtwitter\\.com|vxtwitter\\.com|fixupx\\.com|fixvx\\.com|twittpr\\.com"
LOCAL_NAMES = "^localhost$|\\.(?:localhost|local|internal|lan|home|corp)$"


def post_url(url: Column) -> Column:
    """Canonical address of a social post, from any mirror and whatever follows its number; null for other pages."""
    pattern = f"(?i)^https?://(?:www\\.|mobile\\.)?(?:{POST_HOSTS})/(?:[^?#]*/)?([A-Za-z0-9_]{{1,30}})/status(?:es)?/([0-9]{{1,25}})(?:[/?#].*)?$"
    user, number = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    return F.when(number != "", F.concat(F.lit("https://x.com/"), user, F.lit("/status/"), number))


def redirect_target(url: Column, parameter: str = "target") -> Column:
    """Where an outward link of a site leads: its decoded target parameter, else the address itself."""
    raw = F.regexp_extract(query_text(url), f"(?:^|&){parameter}=([^&]*)", 1)
    target = F.try_url_decode(raw)
    return F.when(is_url(target), target).otherwise(url)


def in_domain(url: Column, domain: Column) -> Column:
    """Whether a host is a domain or lies below it."""
    h = host(url)
    return (h == F.lower(domain)) | h.endswith(F.concat(F.lit("."), F.lower(domain)))


def is_private(url: Column) -> Column:
    """Whether a host's name or IPv4 literal says that it is local or private, or the address carries credentials. A host that
    ends in a number is an IPv4 literal or no host at all: one that is no valid literal is not public either."""
    h = host(url)
    part = lambda k: F.try_to_number(F.split_part(h, F.lit("."), F.lit(k)), F.lit("999")).cast("int")
    number = h.rlike("(?:^|\\.)(?:[0-9]+|0x[0-9a-f]*)\\.?$")
    a, b = part(1), part(2)
    closed = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    return (h == "") | h.rlike(LOCAL_NAMES) | url.rlike("^[^/?#]*//[^/?#]*@") | F.when(number, ipv4(h).isNull() | closed).otherwise(~h.contains("."))


def meta_refresh(html: Column) -> Column:
    """Target of a page's refresh within two seconds, if it has one."""
    tag = "(?is)<meta[^>]*http-equiv=[\"']?refresh[\"']?[^>]*content=[\"']?\\s*[0-2](?:\\.[0-9]+)?\\s*[;,]\\s*url=\\s*['\"]?([^'\">\\s]+)"
    return F.nullif(F.regexp_extract(html, tag, 1), F.lit(""))
