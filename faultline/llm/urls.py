"""URL rules, carried to aliases along redirects and canonical links.

Built-in functions only. A url's own rule decides it: the longest one that fits, an allow
before a block of equal length. A url without a rule takes the decision of its component
over redirect and canonical-link edges: allow if any alias has an explicit allow, block if
any has a block, else allow. Components come from ``components``; no group of aliases is
ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.components import components
from faultline.sources.tables import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"

Rule = tuple[str, str, str]  # host, path, allow or block

#: Comments and elements whose content is text, not tags.
_HIDDEN = (
    r"""(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>])"""
    r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1(?=[\s/>])|\z)""")
_TAGS = r"""(?i)<(?:link|meta|base)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: A name, and a value if there is one; read in order, so that no value is taken for a name.
_ATTRIBUTE = r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?"""
_REFRESH = r"""(?is)^\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]+)|'([^']+)|([^"'].*))"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end.

    Both are empty for null and for urls without ``://``.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def own_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The rule that decides a url as struct(rule, verdict); null if none fits.

    A rule fits its host and all subdomains where the path starts with the rule's. The rules
    are tried longest first, so this is for lists that fit an expression.
    """
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != ALLOW, r[0], r[1]))
    found = None
    for rule_host, rule_path, verdict in order:
        name = translate_host(rule_host)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(rule_path)
        value = F.struct(F.lit(name + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def translate_host(host: str) -> str:
    return host.translate(str.maketrans(UPPER, LOWER))


def _percents(text: Column) -> Column:
    """Percent escapes in capital letters; they are the same escapes."""
    return F.array_join(F.transform(F.split(text, "%"), lambda p: F.when(
        p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substr(p, F.lit(3)))).otherwise(p)), "%")


def resource(url: Column) -> Column:
    """The vertex of a url: without its fragment and the scheme's own port, scheme and host lower-cased, no path as ``/``."""
    host, _ = host_path(url)
    bare = F.regexp_extract(url, "(?s)^[^#]*", 0)
    at = F.instr(bare, "://")
    scheme = F.translate(F.substr(bare, F.lit(1), at + 2), UPPER, LOWER)
    port = F.when(scheme == "http://", ":(80)?$").when(scheme == "https://", ":(443)?$").otherwise(":$")
    rest = F.substr(bare, at + 3 + F.length(host))
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(at > 0, F.concat(scheme, F.regexp_replace(host, port, F.lit("")), _percents(rest))).otherwise(bare)


#: Fixed values of HTML: the references that stand in urls, the ampersand's last.
_REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&sol;", "/"), ("&colon;", ":"), ("&quest;", "?"),
               ("&equals;", "="), ("&num;", "#"), ("&period;", "."), ("&amp;", "&"))


def decoded(value: Column) -> Column:
    """An attribute's value with its character references as characters (numbers up to U+FFFF, and the names above)."""
    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, "^([xX][0-9a-fA-F]{1,4}|[0-9]{1,5});?", 1)
        code = F.when(digits.rlike("^[xX]"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits).cast("bigint")
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        known = (digits != "") & code.between(1, 0xFFFF) & ~code.between(0xD800, 0xDFFF)
        rest = F.regexp_replace(part, "^([xX][0-9a-fA-F]{1,4}|[0-9]{1,5});?", "")
        return F.when(known, F.concat(sign, rest)).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(value, "&#")
    out = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))
    for name, sign in _REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def _without_dots(path: Column) -> Column:
    """A path from its root on without the segments ``.`` and ``..``."""
    return F.aggregate(
        F.split(F.regexp_replace(path, r"(/\.{1,2})$", "$1/"), "/"), F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .when(part == ".", done).otherwise(F.concat(done, F.array(part))),
        lambda done: F.array_join(done, "/"))


def resolved(target: Column, base: Column) -> Column:
    """An absolute url of a link target as it stands in a page, references decoded.

    Null for schemes without ``//`` and for targets that need a base and have none.
    """
    return _resolved(decoded(target), base)


def _resolved(target: Column, base: Column) -> Column:
    def whole(link: Column) -> Column:
        to, page, origin, own = (link[k] for k in ("to", "page", "origin", "own"))
        path = F.regexp_extract(F.substr(page, F.length(origin) + 1), "^[^?#]*", 0)
        behind = F.substr(to, F.length(own) + 1)
        folder = F.concat(F.lit("/"), F.regexp_extract(path, "(?s)^/(.*/)", 1))
        rooted = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
        return (
            F.when(to.rlike(_SCHEME), F.when(to.rlike(_SCHEME + "//"), to))
            .when(to.startswith("//"), F.concat(F.regexp_extract(page, "^[^:/?#]+:", 0), to))
            .when(origin == "", None)
            .when(to.startswith("#"), F.concat(F.regexp_extract(page, "(?s)^[^#]*", 0), to))
            .when(own == "", F.concat(origin, F.when(path == "", "/").otherwise(path), behind))
            .otherwise(F.concat(origin, _without_dots(rooted), behind)))

    def parts(link: Column) -> Column:
        return F.named_struct(
            F.lit("to"), link["to"], F.lit("page"), link["page"],
            F.lit("origin"), F.regexp_extract(link["page"], "^[^:/?#]+://[^/?#]*", 0),
            F.lit("own"), F.regexp_extract(link["to"], "^[^?#]*", 0))

    link = F.named_struct(
        F.lit("to"), F.trim(target), F.lit("page"), base)
    return F.get(F.transform(F.transform(F.array(link), parts), whole), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of that name, without quotes and decoded; null where there is none."""
    inner = F.regexp_replace(tag, r"^<[^\s/>]*", "")
    names = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    at = F.array_position(names, name)
    value = F.get(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(2)), (at - 1).cast("int"))
    return F.when(at > 0, F.trim(decoded(F.regexp_replace(value, r"""^["']|["']$""", ""))))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (source, target) from all canonical links and meta refreshes in the pages.

    Targets are resolved against the page's url, or its base element. Comments, scripts and
    other text-only elements have no tags.
    """
    tags = F.regexp_extract_all(F.regexp_replace(F.col(html), _HIDDEN, " "), F.lit(_TAGS), F.lit(0))
    read = pages.where(F.col(url).isNotNull() & F.col(html).rlike("(?i)canonical|refresh")).select(
        F.col(url).alias("source"), tags.alias("tags"))
    stated = _attribute(F.get(F.filter("tags", lambda t: t.rlike(r"(?is)^<base\s.*\bhref\s*=")), F.lit(0)), "href")
    read = read.select("source", F.coalesce(_resolved(stated, F.col("source")), F.col("source")).alias("base"), F.explode("tags").alias("tag"))
    tag = F.col("tag")
    link, meta = tag.rlike(r"(?i)^<link"), tag.rlike(r"(?i)^<meta")
    canonical = link & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    content = _attribute(tag, "content")
    refresh = F.coalesce(*(F.nullif(F.regexp_extract(content, _REFRESH, k), F.lit("")) for k in (1, 2, 3)))
    target = F.when(canonical, _attribute(tag, "href")).when(
        meta & (F.lower(_attribute(tag, "http-equiv")) == "refresh"), refresh)
    targets = read.select("source", "base", F.nullif(F.trim(target), F.lit("")).alias("target"))
    return targets.select("source", _resolved(F.col("target"), F.col("base")).alias("target")).where(F.col("target").isNotNull())


def judged(urls: DataFrame, rules: Sequence[Rule], edges: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to every row.

    ``edges`` has source and target urls; null ends, loops and repeated edges do nothing, and
    targets need not be rows of ``urls``. Null urls have no rule and are allowed. Columns of
    the four names are replaced, others kept; repeated rows stay.
    """
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_path(F.col(url))
    own = urls.select(*kept, host.alias("host"), path.alias("path")).withColumn(
        "_own", own_rule(F.col("host"), F.col("path"), rules))
    links = stage(edges.select(resource(F.col("source")).alias("a"), resource(F.col("target")).alias("b")), "url-edges")
    members = components(links, "a", "b")
    member_host, member_path = host_path(F.col("vertex"))
    members = stage(members.select(
        "vertex", "component", own_rule(member_host, member_path, rules)["verdict"].alias("said")), "url-members")
    said = members.groupBy("component").agg(
        F.max(F.col("said") == ALLOW).alias("allowed"), F.max(F.col("said") == BLOCK).alias("blocked"))
    said = stage(said.where(F.col("blocked") & ~F.coalesce("allowed", F.lit(False))).select("component"), "url-blocked")
    blocked = members.join(said, "component", "left_semi").select(F.col("vertex").alias("_resource"), F.lit(True).alias("_alias"))
    rows = own.withColumn("_resource", resource(F.col(url))).join(blocked, "_resource", "left")
    return rows.select(
        *kept, "host", "path", F.col("_own.rule").alias("rule"),
        F.coalesce(F.col("_own.verdict"), F.when(F.col("_alias"), BLOCK).otherwise(ALLOW)).alias("verdict"))
