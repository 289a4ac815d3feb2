"""Extraction from text, HTML, JSON and line formats with native expressions.

Every function takes columns and returns columns; arrays keep first-seen order and are distinct.
Null input gives null for scalars and an empty array for lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import host, squeezed, unescaped, visible
from siftline.session import stored

EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
HANDLE = r"(?:^|[^A-Za-z0-9_@/.+-])@([A-Za-z][A-Za-z0-9_]{4,31})"
LINK_HANDLE = r"(?i)\bt(?:elegram)?\.me/(?!joinchat|\+)([A-Za-z][A-Za-z0-9_]{4,31})"
URL = r"(https?://[^\s<>\"')\]]+)"

# Local parts of mailboxes that belong to a role.
ROLES = ("abuse", "admin", "affiliates", "billing", "contact", "hello", "help", "info", "mail", "media", "noreply", "office", "postmaster", "press", "sales", "support", "team", "webmaster")


def _all(c: Column, pattern: str) -> Column:
    return F.array_distinct(F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.array().cast("array<string>")))


def emails(c: Column) -> Column:
    return F.array_distinct(F.transform(_all(c, EMAIL), lambda x: F.lower(x)))


def without_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, " ")


def handles(c: Column) -> Column:
    """Handles written with an at-sign or as a link, in lower case; addresses are no handles."""
    bare = without_emails(c)
    return F.array_distinct(F.concat(F.transform(_all(bare, HANDLE), lambda x: F.lower(x)), F.transform(_all(bare, LINK_HANDLE), lambda x: F.lower(x))))


def urls(c: Column) -> Column:
    return F.transform(_all(c, URL), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))


def web_domains(c: Column) -> Column:
    """Hosts of the links of a text that can be a public web host."""
    hosts = F.array_distinct(F.transform(urls(c), host))
    return F.filter(hosts, valid_domain)


def valid_domain(h: Column) -> Column:
    """Labels of letters, digits and inner hyphens, two at least, and a top level of letters."""
    return F.coalesce(h.rlike(r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}$"), F.lit(False))


def contacts(c: Column) -> Column:
    """Addresses, handles and sites of a text as structs of type and value."""

    def typed(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    return F.concat(typed("email", emails(c)), typed("telegram", handles(c)), typed("site", web_domains(c)))


def is_role(email: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.lower(email), "@", 1), r"[+.].*$", "").isin(*ROLES)


def only_roles(found: Column) -> Column:
    """Whether there are addresses and all of them belong to a role."""
    mails = F.filter(found, lambda x: x["type"] == "email")
    return (F.size(mails) > 0) & F.forall(mails, lambda x: is_role(x["value"]))


def on_domain(email: Column, domain: Column) -> Column:
    """Whether an address is at a domain or below it."""
    at = F.lower(F.substring_index(email, "@", -1))
    return F.coalesce((at == domain) | F.endswith(at, F.concat(F.lit("."), domain)), F.lit(False))


def merged(*lists: Column) -> Column:
    """Union of contact lists, first seen first, distinct by type and lower-case value."""
    every = F.concat(*[F.coalesce(x, F.array().cast("array<struct<type:string,value:string>>")) for x in lists])
    return F.aggregate(
        every,
        F.array().cast("array<struct<type:string,value:string>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["type"] == x["type"]) & (F.lower(y["value"]) == F.lower(x["value"]))), acc).otherwise(F.array_append(acc, F.struct(x["type"].alias("type"), x["value"].alias("value")))),
    )


def formatted(found: Column) -> Column:
    """Contacts as text: bare addresses, everything else as type:value."""
    return F.transform(found, lambda x: F.when(x["type"] == "email", x["value"]).otherwise(F.concat(x["type"], F.lit(":"), x["value"])))


# pages


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, quoted or not; empty where it has none."""
    raw = F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.regexp_replace(raw, r"^[\"']|[\"']$", "")


def inside(html: Column, element: str) -> Column:
    """What stands in the first element of a name, up to its end or the next element; null without one."""
    behind = F.try_element_at(F.split(html, rf"(?i)<{element}(?=[\s>])[^>]*>", 2), F.lit(2))
    return F.split(behind, rf"(?i)</{element}\s*>", 2)[0]


def page_title(html: Column) -> Column:
    return F.nullif(squeezed(unescaped(inside(html, "title"))), F.lit(""))


def meta_description(html: Column) -> Column:
    """Content of the first meta tag of this name, whatever the order of its attributes."""
    metas = F.regexp_extract_all(html, F.lit(r"(?i)(<meta(?=[\s/])[^>]*>)"), F.lit(1))
    named = F.filter(metas, lambda t: F.lower(attribute(t, "name")) == "description")
    return F.nullif(squeezed(unescaped(attribute(F.try_element_at(named, F.lit(1)), "content"))), F.lit(""))


def links(html: Column) -> Column:
    return _all(html, r"(?i)<a\b[^>]*\bhref=[\"']([^\"'#]+)[\"']")


def unwrapped(url: Column, parameter: str) -> Column:
    """The link that a redirect carries in a parameter, decoded; the link itself where it carries none."""
    carried = F.regexp_extract(url, rf"[?&]{parameter}=([^&#]*)", 1)
    return F.when(carried != "", F.try_url_decode(carried)).otherwise(url)


def path_parts(url: Column) -> Column:
    """Parts of the path of a link; an empty path has one empty part."""
    path = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "")
    return F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/+")


def permalink(url: Column) -> Column:
    """One spelling of a link: https, host in lower case without www, path without final slash, no query or fragment."""
    path = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "")
    site = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    return F.concat(F.lit("https://"), site, F.regexp_replace(path, r"/+$", ""))


def literal_kind(word: Column) -> Column:
    """What a string literal of a page is: link, asset, blob, no_letter or text."""
    return (
        F.when(word.rlike(r"^https?://"), "link")
        .when(F.lower(word).rlike(r"\.(?:js|css|png|jpe?g|svg|gif|woff2?|ico)$"), "asset")
        .when((F.length(word) >= 40) & word.rlike(r"^[A-Za-z0-9+/=_-]+$"), "blob")
        .when(~word.rlike(r"\p{L}"), "no_letter")
        .otherwise("text")
    )


def page_text(html: Column) -> Column:
    """struct(text, method): embedded JSON state, else description, else visible text."""
    state = F.regexp_extract(html, r"(?s)<script[^>]+type=[\"']application/(?:ld\+)?json[\"'][^>]*>(.*?)</script>", 1)
    return F.when(F.length(state) > 0, F.struct(squeezed(state).alias("text"), F.lit("json").alias("method"))).otherwise(
        F.when(meta_description(html).isNotNull(), F.struct(meta_description(html).alias("text"), F.lit("meta").alias("method"))).otherwise(
            F.when(F.length(visible(html)) > 0, F.struct(visible(html).alias("text"), F.lit("static").alias("method"))).otherwise(F.struct(F.lit("").alias("text"), F.lit("empty").alias("method")))
        )
    )


#: Levels of a document that one stored step unfolds.
LEVELS = 12


def json_leaves(df: DataFrame, column: str, key: str) -> DataFrame:
    """key and leaf: every string leaf of a JSON document, however deep; broken JSON has none.

    Read as a variant and unfolded level by level in the JVM, ``LEVELS`` at a time; what lies deeper
    is stored with the leaves and unfolded in turn until nothing is left.
    """
    level = df.select(key, F.try_parse_json(F.col(column)).alias("v")).where("v is not null")
    out = None
    while True:
        found = None
        for _ in range(LEVELS):
            level = level.select(key, F.schema_of_variant("v").alias("_kind"), "v")
            leaves = level.where(F.col("_kind") == "STRING").select(key, F.try_variant_get("v", "$", "string").alias("leaf"))
            found = leaves if found is None else found.unionByName(leaves)
            deeper = level.where(F.col("_kind").startswith("OBJECT") | F.col("_kind").startswith("ARRAY"))
            level = deeper.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("value").alias("_w"))).select(key, F.col("_w").alias("v"))
        both = stored(found.unionByName(level, allowMissingColumns=True), "leaves")
        leaves, level = both.where("leaf is not null").select(key, "leaf"), both.where("v is not null").select(key, "v")
        out = leaves if out is None else out.unionByName(leaves)
        if level.isEmpty():
            return out


# Class names of authors and posts in common forum software.
AUTHOR_CLASSES = ("username",)
BODY_CLASSES = ("postbody", "bbWrapper")


def _opened(classes: tuple[str, ...]) -> str:
    """Pattern of an opening tag whose class list has one of the names."""
    return rf"(?i)<[a-z][^>]*\sclass\s*=\s*[\"']?(?:[^\"'>]*\s)?(?:{'|'.join(classes)})(?=[\s\"'>])[^>]*>"


def forum_posts(html: Column, authors: tuple[str, ...] = AUTHOR_CLASSES, bodies: tuple[str, ...] = BODY_CLASSES) -> Column:
    """Array of struct(author, body): a page is cut where an author is named, and each piece holds the post.

    A piece without a body has an empty one; a body ends with its element or with the piece.
    """
    pieces = F.split(html, _opened(authors))
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def post(piece: Column) -> Column:
        body = F.coalesce(F.try_element_at(F.split(piece, _opened(bodies), 2), F.lit(2)), F.lit(""))
        return F.struct(visible(F.split(piece, "</", 2)[0]).alias("author"), visible(F.split(body, r"(?i)</(?:div|article)\s*>", 2)[0]).alias("body"))

    return F.transform(pieces, post)


def sitemap_locations(xml: Column) -> Column:
    return F.transform(_all(xml, r"(?is)<loc>\s*(.*?)\s*</loc>"), unescaped)


def robots_sitemaps(text: Column) -> Column:
    """Distinct locations of the lines whose field, before the first colon, is sitemap."""
    lines = F.transform(F.split(text, r"\R"), lambda x: F.split(F.split(x, "#", 2)[0], ":", 2))
    own = F.filter(lines, lambda f: (F.size(f) == 2) & (F.lower(F.trim(f[0])) == "sitemap") & (F.trim(F.try_element_at(f, F.lit(2))) != ""))
    return F.array_distinct(F.transform(own, lambda f: F.trim(f[1])))


def seller_lines(body: Column) -> Column:
    """Lines of an ads.txt file as struct(domain, pub_id, relation, cert_id); comments and variables left out."""
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"#.*$", "")))
    rows = F.transform(lines, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y)))
    good = F.filter(rows, lambda r: (F.size(r) >= 3) & (F.length(r[0]) > 0) & (F.length(r[1]) > 0) & F.upper(r[2]).isin("DIRECT", "RESELLER"))
    return F.transform(good, lambda r: F.struct(F.lower(r[0]).alias("domain"), r[1].alias("pub_id"), F.upper(r[2]).alias("relation"), F.try_element_at(r, F.lit(4)).alias("cert_id")))


def file_contact(body: Column) -> Column:
    """Value of the first CONTACT directive."""
    return F.nullif(F.trim(F.regexp_extract(body, r"(?im)^\s*contact\s*=\s*([^\r\n#]+)", 1)), F.lit(""))


def sellers(json: Column) -> Column:
    """Sellers of a sellers.json document."""
    return F.from_json(json, "struct<sellers:array<struct<seller_id:string,name:string,domain:string,seller_type:string>>>")["sellers"]
