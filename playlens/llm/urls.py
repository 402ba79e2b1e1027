"""URL rules whose block decisions reach all aliases of a page.

Rules decide by host and path. Pages that redirect to each other, or name the same canonical
address, are one class: connected components over those edges. A page without a rule
of its own is blocked if its class has a blocked member and no explicitly allowed one. Only
DataFrame operations.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from playlens.llm.components import components
from playlens.llm.common import save

#: After the first "://": host, then path.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Fixed values of HTML. What holds no links, link and meta elements, and the value of an attribute.
NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|noscript|template)\b.*?(?:</\1\s*>|\z)"
ELEMENT = r"(?is)<(?:link|meta)\b[^>]*>"
VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH = r"(?is)^[\s\d.]*[;,]?\s*url\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\"'].*))"
#: Character references with a name; these are all that have an ASCII character.
REFERENCES = {
    "Tab": 9, "NewLine": 10, "excl": 33, "quot": 34, "QUOT": 34, "num": 35, "dollar": 36, "percnt": 37, "amp": 38, "AMP": 38, "apos": 39,
    "lpar": 40, "rpar": 41, "ast": 42, "midast": 42, "plus": 43, "comma": 44, "period": 46, "sol": 47, "colon": 58, "semi": 59,
    "lt": 60, "LT": 60, "equals": 61, "gt": 62, "GT": 62, "quest": 63, "commat": 64, "lsqb": 91, "lbrack": 91, "bsol": 92,
    "rsqb": 93, "rbrack": 93, "Hat": 94, "lowbar": 95, "UnderBar": 95, "grave": 96, "DiacriticalGrave": 96, "lcub": 123, "lbrace": 123,
    "verbar": 124, "vert": 124, "VerticalLine": 124, "rcub": 125, "rbrace": 125,
}


@dataclass(frozen=True)
class Rule:
    """`verdict` is allow or block. Fits `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, where `value` stands in the plan once, however often `body` names it.

    Without it, steps that each name the step before several times make a plan that grows as a power of their number.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def host(url: Column) -> Column:
    """Host with A-Z in lower case; empty without "://" or for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def winner(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, allow before block; null if none.

    The rules are part of the plan, so their number is meant to be some hundreds at most.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def node(url: Column) -> Column:
    """What stands for an address: no scheme, no fragment, host in lower case, no slash at the end."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^#]*?(\?[^#]*)", 1)
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), query)


def attribute(element: Column, name: str) -> Column:
    """The value of an attribute of a tag; empty without one."""
    pattern = rf"(?is)(?<![\w-]){name}{VALUE}"
    return F.concat(*(F.regexp_extract(element, pattern, i) for i in (1, 2, 3)))


def decoded(text: Column) -> Column:
    """`text` with its character references replaced: all numeric ones, and names of ASCII characters."""
    names = F.create_map(*(F.lit(x) for pair in REFERENCES.items() for x in pair))

    def number(found: Column) -> Column:
        return (
            F.when(found.rlike("^#[xX]"), F.conv(F.substring(found, 3, 6), 16, 10).cast("int"))
            .when(found.startswith("#"), F.substring(found, 2, 7).cast("int"))
            .when(found != "", F.try_element_at(names, found))
        )

    def replaced(code: Column, part: Column, found: Column) -> Column:
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # A code point as it stands in UTF-32.
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.substr(part, F.length(found) + 2)
        return F.when(valid, F.concat(character, rest)).otherwise(F.concat(F.lit("&"), part))

    def piece(part: Column) -> Column:
        reference = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);", 1)
        return bound(reference, lambda found: bound(number(found), lambda code: replaced(code, part, found)))

    parts = F.split(text, "&")
    return bound(parts, lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, 2, F.size(p)), piece), "")))


def _without_dots(path: Column) -> Column:
    """A path without the segments . and .. (the latter takes the one before it along)."""
    def step(done: Column, segment: Column) -> Column:
        up = F.regexp_replace(done, r"/[^/]*$", "")
        return F.when(segment == ".", done).when(segment == "..", up).otherwise(F.concat(done, F.lit("/"), segment))

    def clean(path: Column) -> Column:
        kept = F.aggregate(F.slice(F.split(path, "/"), 2, 1 << 20), F.lit(""), step)
        return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(kept, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)

    return bound(path, clean)


def resolved(base: Column, link: Column) -> Column:
    """`link` as a full address, seen from the page at `base`; null for a scheme without "//" (mailto: and the like).

    <base> elements are not regarded.
    """
    at = F.struct(
        F.concat(F.regexp_extract(base, r"(?s)^(.*?://)", 1), host(base)).alias("site"), path(base).alias("path"),
        F.regexp_extract(base, r"(?s)^(.*?:)//", 1).alias("scheme"),
        F.regexp_extract(link, r"(?s)^([^?#]*)", 1).alias("target"), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1).alias("rest"),
    )

    def relative(at: Column) -> Column:
        below = F.concat(F.regexp_replace(at["path"], "[^/]*$", ""), at["target"])
        full = F.when(at["target"].startswith("/"), at["target"]).otherwise(
            bound(below, lambda b: F.when(b.startswith("/"), b).otherwise(F.concat(F.lit("/"), b)))
        )
        return (
            F.when(link.startswith("//"), F.concat(at["scheme"], link))
            .when(at["target"] == "", F.concat(at["site"], at["path"], at["rest"]))
            .otherwise(F.concat(at["site"], _without_dots(full), at["rest"]))
        )

    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), link)
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(bound(at, relative))
    )


def declared(html: Column) -> Column:
    """Array of the links that the canonical and refresh elements of a page hold, as they stand there, references decoded."""
    def value(element: Column) -> Column:
        names_it = F.array_contains(F.split(F.lower(F.trim(attribute(element, "rel"))), r"\s+"), "canonical")
        refreshes = F.lower(F.trim(attribute(element, "http-equiv"))) == "refresh"
        held = F.when(element.rlike("(?i)^<link") & names_it, attribute(element, "href")).when(
            element.rlike("(?i)^<meta") & refreshes, attribute(element, "content")
        )
        return F.struct(element.rlike("(?i)^<meta").alias("meta"), held.alias("value"))

    def link(found: Column) -> Column:
        def of(text: Column) -> Column:
            after = F.concat(*(F.regexp_extract(text, REFRESH, i) for i in (1, 2, 3)))
            return F.regexp_replace(F.when(found["meta"], after).otherwise(text), r"^[\x00-\x20]+|[\x00-\x20]+$", "")

        return bound(decoded(found["value"]), of)

    text = F.concat(F.regexp_replace(html, NO_MARKUP, " "), F.lit(">"))  # the last element may be cut off
    elements = F.regexp_extract_all(text, F.lit(ELEMENT), F.lit(0))
    values = F.filter(F.transform(elements, value), lambda found: found["value"] != "")
    return F.filter(F.transform(values, link), lambda x: x != "")


def aliases(pages: DataFrame) -> DataFrame:
    """(source, target): redirects and canonical links that the pages themselves declare, all of them.

    What stands in comments, scripts and the like is no link. Null and empty addresses and pages declare none.
    Both steps are exploded: as plain columns, they would be repeated in every condition on the target.
    """
    rows = pages.where("url IS NOT NULL AND html IS NOT NULL").select(
        F.col("url").alias("source"), F.explode(declared(F.col("html"))).alias("link")
    )
    return rows.select("source", F.explode(F.array_compact(F.array(resolved(F.col("source"), F.col("link"))))).alias("target"))


def judge(pages: DataFrame, edges: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of `pages`.

    `edges` holds alias pairs (source, target) of full addresses, whether their pages are
    in `pages` or not: a blocked address blocks its aliases even if it was never crawled.
    Null and broken addresses have no host, fit no rule and are allowed. Repeated rows
    are judged alike, very long addresses are read whole, and empty tables give no row.
    """
    source, target = F.col("source"), F.col("target")
    ends = edges.select(
        node(source).alias("a"), node(target).alias("b"),
        host(source).alias("ha"), path(source).alias("pa"), host(target).alias("hb"), path(target).alias("pb"),
    ).where("a <> b AND a <> '' AND b <> ''")
    ends = save(ends.select(
        "a", "b",
        winner(F.col("ha"), F.col("pa"), rules)["verdict"].alias("va"), winner(F.col("hb"), F.col("pb"), rules)["verdict"].alias("vb"),
    ), "aliases")
    explicit = ends.select(F.col("a").alias("node"), F.col("va").alias("v")).unionByName(
        ends.select(F.col("b").alias("node"), F.col("vb").alias("v"))
    ).where("v IS NOT NULL").distinct()
    classes = components(ends.select("a", "b"))
    blocked = (
        classes.join(explicit, "node").groupBy("component")
        .agg(F.bool_or(F.col("v") == "block").alias("block"), F.bool_or(F.col("v") == "allow").alias("allow"))
        .where("block AND NOT allow").select("component")
        .join(classes, "component").select("node", F.lit(True).alias("blocked"))
    )
    url = F.col("url")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), node(url).alias("node"))
    rows = rows.withColumn("own", winner(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("own").isNotNull(), F.col("own.verdict")).when(F.col("blocked"), "block").otherwise("allow")
    return rows.join(blocked, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict")
    )


def digest(pages: DataFrame) -> DataFrame:
    """The verdict on every page, with the aliases that the pages declare."""
    return judge(pages, aliases(pages))


def shared_addresses(pages: DataFrame) -> DataFrame:
    """The verdict on every page, as if each five neighbours by page_id redirected to the first of them.

    The edges are derived from `pages`, so that classes decide verdicts whatever the pages declare.
    """
    five = F.floor(F.col("page_id") / 5).cast("bigint")
    firsts = pages.groupBy(five.alias("five")).agg(F.min_by("url", F.struct("page_id", "url")).alias("target"))
    edges = pages.select(F.col("url").alias("source"), five.alias("five")).join(firsts, "five").select("source", "target")
    return judge(pages, edges)
