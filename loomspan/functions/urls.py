"""URL expressions: names of files, links, and which of them to follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of files that are never pages.
SKIPPED = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".mp4", ".mp3", ".avi", ".zip", ".rar", ".exe", ".css", ".js", ".xml", ".json")
#: Schemes of links that lead to no page.
NOT_PAGES = ("mailto:", "javascript:", "tel:")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path, empty where there is none."""
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    return F.regexp_replace(rest, r"[?#].*$", "")


def markdown_name(url: Column) -> Column:
    """A stable file name for a page's text: its path with hyphens."""
    trimmed = F.btrim(path(url), F.lit("/"))
    slug = F.when(trimmed != "", F.replace(trimmed, F.lit("/"), F.lit("-"))).otherwise(host(url))
    slug = F.btrim(F.regexp_replace(slug, "[^a-zA-Z0-9._-]", "-"), F.lit("-"))
    return F.concat(F.lit("web__"), F.when(slug != "", slug).otherwise(F.lit("index")), F.lit(".md"))


def pdf_name(url: Column) -> Column:
    """A file name with the ending .pdf; a digest where the path has no last part."""
    name = F.regexp_extract(F.rtrim(path(url), F.lit("/")), r"([^/]*)$", 1)
    name = F.when(name != "", name).otherwise(F.substring(F.sha2(url, 256), 1, 16))
    return F.when(F.endswith(F.lower(name), F.lit(".pdf")), name).otherwise(F.concat(name, F.lit(".pdf")))


def is_pdf(url: Column) -> Column:
    return F.endswith(F.lower(path(url)), F.lit(".pdf"))


def is_skipped(url: Column) -> Column:
    """Whether the path's extension is one of a file that is no page."""
    return F.lower(F.regexp_extract(path(url), r"(\.[^./]*)$", 1)).isin(*SKIPPED)


def is_allowed(url: Column, prefixes: list[str]) -> Column:
    allowed = F.lit(False)
    for prefix in prefixes:
        allowed = allowed | F.startswith(url, F.lit(prefix))
    return allowed


def is_page_link(href: Column) -> Column:
    """Whether a link's target is given and may be a page."""
    keep = href != ""
    for scheme in NOT_PAGES:
        keep = keep & ~F.startswith(href, F.lit(scheme))
    return keep


def resolve(base: Column, href: Column) -> Column:
    """A link's absolute URL, without query and fragment. Dot segments are resolved."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.concat(root, F.when(path(base) == "", F.lit("/")).otherwise(F.regexp_replace(path(base), r"[^/]*$", "")))
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when((href == "") | F.startswith(href, F.lit("#")) | F.startswith(href, F.lit("?")), bare)
        .otherwise(F.concat(folder, href))
    )
    plain = F.regexp_replace(joined, r"[?#].*$", "")
    parts = F.split(path(plain), "/")
    none = F.array().cast("array<string>")
    walked = F.aggregate(
        parts,
        none,
        lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.lit(1), F.size(kept) - 1))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part))),
    )
    ends_in_dots = F.element_at(parts, -1).isin(".", "..")
    clean = F.concat(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.array_join(walked, "/"), F.when(ends_in_dots, F.lit("/")).otherwise(F.lit("")))
    return F.when(plain.rlike(r"/\.\.?(/|$)"), clean).otherwise(plain)
