"""URL filters with redirect equivalence, in DataFrame functions only.

Host and path rules decide a url (the longest wins). Canonical links and refresh redirects found in the pages are
edges between urls; connected components over them hand a block to every alias that no rule decides, whether or not
the blocked url is itself a page. A url that a rule allows stays allowed whatever its aliases are. Urls that differ
only in scheme or fragment are one.

Edge cases: a null url, or one without `://`, has an empty host and path, no rule and no aliases, and is allowed; null
html has no edges; all canonical links and refreshes of a page count; their character references are decoded (numeric
ones, and amp, lt, gt, quot, apos) and relative targets are resolved against the page's url, or its first base element's
if that has an http address; links inside comments, scripts and styles don't count;
repeated rows are judged row by row; no rows give no rows; columns beside page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, hot_keys, materialize, repeated
from .components import connected_components

#: Verdict and rule, a host and the beginning of a path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST, PATH, REST = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)", r"(?s)^.*?://[^/?#]*([^#]*)"
LINK, META, BASE = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>", r"(?is)<base\b[^>]*>"
#: What a browser doesn't read as markup.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|template)\b.*?(?:</\1\b|\z)"
#: What follows the wait in a refresh, with or without url= and quotes.
REFRESH = r"""(?is)^\s*+(?:[\d.]++(?:\s*+[;,]|\s++)\s*+(?:url\s*+=\s*+)?+|url\s*+=\s*+)(?:"([^"]*)|'([^']*)|([^"'].*))"""
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
PIECES = r"(?is)&#x[0-9a-f]+;?|&#[0-9]+;?|&(?:amp|lt|gt|quot|apos);|&|[^&]+"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def alias_key(url: Column) -> Column:
    """What urls of one page share: host, path and query; null without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_extract(url, REST, 1)))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """verdict and rule of the longest rule that fits (of equally long ones, an allowing one); null if none."""

    def fits(verdict, rule):
        at = rule.index("/")
        on = (host == rule[:at]) | host.endswith("." + rule[:at])
        return F.when(on & path.startswith(rule[at:]), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule")))

    return F.coalesce(*(fits(*r) for r in sorted(rules, key=lambda r: (-len(r[1]), r[0]))))


def _groups(text: Column, pattern: str) -> Column:
    """The one of three groups that matched; empty if none did."""
    return F.concat(*(F.regexp_extract(text, pattern, i) for i in (1, 2, 3)))


def attribute(tag: Column, name: str) -> Column:
    """The raw value of an attribute: in double or single quotes, or bare; empty if it has none."""
    return _groups(tag, rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _character(piece: Column) -> Column:
    """What a numeric reference stands for, or the piece itself."""
    digits = F.regexp_extract(piece, r"(?i)^&#x?0*([0-9a-f]*);?$", 1)
    hexed = piece.rlike("(?i)^&#x")
    point = F.when(hexed, F.conv(F.substring(digits, 1, 6), 16, 10)).otherwise(F.regexp_extract(F.substring(digits, 1, 7), "^[0-9]*", 0)).try_cast("int")
    valid = (F.length(digits) <= F.when(hexed, 6).otherwise(7)) & (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    point = F.when(F.coalesce(valid, F.lit(False)), point).otherwise(0xFFFD)
    return F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")


def unescaped(value: Column) -> Column:
    """value with its character references decoded once: numeric ones, and amp, lt, gt, quot and apos."""

    def one(piece):
        out = F.when(piece.rlike("(?i)^&#x?[0-9a-f]+;?$"), _character(piece))
        for name, character in NAMED.items():
            out = out.when(F.lower(piece) == name, F.lit(character))
        return out.otherwise(piece)

    return F.when(value.contains("&"), F.array_join(F.transform(F.regexp_extract_all(value, F.lit(PIECES), F.lit(0)), one), "")).otherwise(value)


def without_dots(path: Column) -> Column:
    """A path that begins with / without its . and .. segments."""
    dots = F.lit(".."), F.lit(".")
    start = F.array(F.lit(""))
    kept = F.aggregate(F.slice(F.split(path, "/"), 2, 1 << 30), start, lambda acc, x: F.when(x == dots[0], F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))).when(x == dots[1], acc).otherwise(F.concat(acc, F.array(x))))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def resolved(url: Column, target: Column) -> Column:
    """target as seen from the page url; null if it is empty or only a fragment."""
    scheme, host, path = F.regexp_extract(url, r"(?s)^(.*?)://", 1), host_of(url), path_of(url)
    bare = F.regexp_extract(target, r"(?s)^[^#]*", 0)
    own, query = F.regexp_extract(bare, r"(?s)^[^?]*", 0), F.regexp_extract(bare, r"(?s)\?.*$", 0)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^.*/", 0))
    root = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(bare == "", None)
        .when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), bare)
        .when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare))
        .when(bare.startswith("?"), F.concat(root, path, bare))
        .when(bare.startswith("/"), F.concat(root, without_dots(own), query))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), query))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """a, b: alias keys joined by a canonical link or a redirect of a page."""

    def tags(pattern, word):
        return F.filter(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)), lambda tag: tag.rlike(f"(?i){word}"))

    def old(tag, name):  # broken quotes
        return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']?([^"'\s>]+)""", 1)

    def step(rows, **made):  # a generator is not merged with the next step, which would repeat its expressions
        for name, value in made.items():
            rows = rows.select("*", F.explode(F.array(value)).alias(name))
        return rows

    # the few pages with such a word, and of these what a browser reads
    some = pages.where(F.col("html").rlike(r"(?i)canonical|refresh|&#")).select("url", F.explode(F.array(F.regexp_replace("html", UNREAD, " "))).alias("html"))
    base = unescaped(attribute(F.regexp_extract("html", BASE, 0), "href"))
    some = step(some, base=F.when(base.rlike(r"(?i)^https?://"), base).otherwise(F.col("url")))
    found = some.select("url", "base", F.explode(F.concat(tags(LINK, r"canonical|&#"), tags(META, r"refresh|&#"))).alias("tag"))
    tag, link = F.col("tag"), F.col("tag").rlike(r"(?i)^<link\b")
    found = step(found, kind=F.when(link, attribute(tag, "rel")).otherwise(attribute(tag, "http-equiv")), value=F.when(link, attribute(tag, "href")).otherwise(attribute(tag, "content")))
    found = step(found, role=unescaped(F.col("kind")), text=unescaped(F.col("value")), rest=F.when(link, old(tag, "href")).otherwise(old(tag, "url")))
    found = found.where(F.when(link, F.col("role").rlike(r"(?i)(^|\s)canonical(\s|$)")).otherwise(F.col("role").rlike(r"(?i)^\s*refresh\s*$")))
    found = step(found, content=F.when(link, F.col("text")).otherwise(_groups(F.col("text"), REFRESH)), plain=unescaped(F.col("rest")))
    found = step(found, raw=F.regexp_replace(F.regexp_replace(F.when(F.col("content") != "", F.col("content")).otherwise(F.col("plain")), r"[\t\r\n\f]", ""), "^ +| +$", ""))
    found = step(found, target=resolved(F.col("base"), F.col("raw")))
    found = step(found, a=alias_key(F.col("url")), b=alias_key(F.col("target"))).select("a", "b")
    return found.where("a is not null and b is not null and a <> b").distinct()


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, host, path, rule, verdict, component (the smallest alias; null if it has none).

    A component of very many urls, and a url of very many pages, are joined by parts; pages without a host have no alias
    and are answered apart.
    """
    joined = materialize(connected_components(alias_edges(pages)), "components")
    large = hot_keys(joined.groupBy("component").agg(F.count("*").alias("n")), ["component"], joined.count())
    slash = F.concat(F.col("node"), F.lit("#"))  # a key reads like a url without its scheme
    node_host, node_path = F.regexp_extract(slash, r"(?s)^([^/?#]*)", 1), F.regexp_extract(slash, r"(?s)^[^/?#]*([^?#]*)", 1)
    bad = joined.where(matching_rule(node_host, node_path, rules)["verdict"] == "block").select("component").distinct().withColumn("bad", F.lit(True))
    aliases = dealt(joined, large, ["component"], "node").join(repeated(bad, large, ["component"]), ["component", "_salt"], "left")
    aliases = aliases.select(F.col("node").alias("alias"), "component", "bad")
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), alias_key(F.col("url")).alias("alias"))
    judged = judged.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    named, nameless = judged.where("alias is not null"), judged.where("alias is null")
    often = hot_keys(named.groupBy("alias").agg(F.count("*").alias("n")), ["alias"], pages.count())
    found = dealt(named, often, ["alias"], "page_id").join(repeated(aliases, often, ["alias"]), ["alias", "_salt"], "left").drop("_salt")
    judged = found.unionByName(nameless, allowMissingColumns=True)
    inherited = F.when(F.col("bad"), F.lit("block")).otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", inherited).alias("verdict"), "component")

