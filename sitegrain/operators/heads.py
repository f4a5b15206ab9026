"""Head enrichment: missing tags, canonical links, Markdown alternates, managed graph."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import graph as G
from ..functions import paths
from ..functions.html import dom, scanner

MANAGED = "data-sitegrain-graph"


def _attr(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def meta(key: str, content: str, **more: str) -> str:
    kind = "property" if re.match(r"(og|article):", key) else "name"
    extra = "".join(f' {k}="{_attr(v)}"' for k, v in more.items())
    return f'<meta {kind}="{_attr(key)}" content="{_attr(content)}"{extra}>'


def link(rel: str, href: str, **more: str) -> str:
    extra = "".join(f' {k}="{_attr(v)}"' for k, v in more.items())
    return f'<link rel="{rel}"{extra} href="{_attr(href)}">'


def head_tags(facts: dict) -> list[tuple[str, str]]:
    """(key, tag) of what a page's facts give: description, robots, social tags, alternates.

    Facts: title, description, canonical, image, images, language, locale_alternates,
    robots, site_name, type, published, modified, authors, theme_colors, hreflang,
    feeds, previous, next, twitter (dict).
    """
    out: list[tuple[str, str]] = []

    def say(key: str, value: str | None) -> None:
        if value:
            out.append((key, meta(key, value)))

    say("description", facts.get("description"))
    say("robots", facts.get("robots"))
    if facts.get("canonical"):
        out.append(("canonical", link("canonical", facts["canonical"])))
    say("og:title", facts.get("title"))
    say("og:description", facts.get("description"))
    say("og:url", facts.get("canonical"))
    say("og:type", facts.get("type"))
    say("og:site_name", facts.get("site_name"))
    say("og:locale", (facts.get("language") or "").replace("-", "_") or None)
    for value in facts.get("locale_alternates") or ():
        say("og:locale:alternate", value)
    for image in facts.get("images") or ([{"url": facts["image"]}] if facts.get("image") else []):
        say("og:image", image["url"])
        for part in ("width", "height", "type", "alt"):
            say(f"og:image:{part}", str(image[part]) if image.get(part) else None)
    say("article:published_time", facts.get("published"))
    say("article:modified_time", facts.get("modified"))
    for author in facts.get("authors") or ():
        say("article:author", author)
    twitter = facts.get("twitter") or {}
    say("twitter:card", twitter.get("card") or ("summary_large_image" if facts.get("image") else None))
    for part, of in (("title", "title"), ("description", "description"), ("image", "image"), ("site", None), ("creator", None), ("player", None)):
        say(f"twitter:{part}", twitter.get(part) or (facts.get(of) if of else None))
    for colour in facts.get("theme_colors") or ():
        say("theme-color", colour)
    out += [("hreflang", link("alternate", h, hreflang=c)) for c, h in (facts.get("hreflang") or {}).items()]
    out += [("feed", link("alternate", f["href"], type=f["type"], title=f.get("title", ""))) for f in facts.get("feeds") or ()]
    out += [(k, link(r, facts[k])) for k, r in (("previous", "prev"), ("next", "next")) if facts.get(k)]
    return out


def fill_head(text: str, facts: dict) -> str:
    """Insert the tags of keys that the head does not have; nothing else changes."""
    have = set()
    for tag, attrs in scanner.head_tags(text):
        if tag.name == "meta":
            have |= {attrs[k].lower() for k in ("name", "property") if k in attrs}
        elif tag.name == "link":
            rel = attrs.get("rel", "").lower().split()
            have |= {"canonical"} & set(rel) | ({"previous"} if "prev" in rel else set()) | ({"next"} if "next" in rel else set())
            have |= {"hreflang"} if "hreflang" in attrs else set()
            have |= {"feed"} if "alternate" in rel and re.search("rss|atom", attrs.get("type", "")) else set()
    return scanner.insert_into_head(text, "".join(tag for key, tag in head_tags(facts) if key not in have))


def replace_head(text: str, facts: dict) -> str:
    """Replace the families of tags that the facts speak of."""
    tags = head_tags(facts)
    keys = {k for k, _ in tags}
    text = scanner.remove_head_tags(text, "meta", lambda a: (a.get("property") or a.get("name") or "").lower() in keys)
    for key, rel in (("canonical", "canonical"), ("previous", "prev"), ("next", "next")):
        if key in keys:
            text = scanner.remove_head_tags(text, "link", lambda a, rel=rel: rel in a.get("rel", "").lower().split())
    if facts.get("title"):
        text = scanner.remove_head_tags(text, "title", lambda a: True, whole=True)
        title = facts["title"].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        text = scanner.insert_into_head(text, f"<title>{title}</title>")
    return scanner.insert_into_head(text, "".join(tag for _, tag in tags))


def _is_markdown_link(attrs: dict) -> bool:
    return "alternate" in attrs.get("rel", "").lower().split() and attrs.get("type", "").strip().lower() == "text/markdown"


def with_alternate(text: str, href: str, mode: str = "auto") -> str:
    """A link to the Markdown copy: added if there is none, or replacing the first (``always``)."""
    tag = link("alternate", href, type="text/markdown")
    if any(_is_markdown_link(a) for _, a in scanner.head_tags(text, "link")):
        return scanner.replace_head_tag(text, "link", _is_markdown_link, tag) if mode == "always" else text
    return scanner.insert_into_head(text, tag)


def canonical_of(text: str, base: str | None) -> tuple[str | None, bool]:
    """(canonical, conflict) of the head's canonical links: one valid URL decides."""
    found = []
    for _, attrs in scanner.head_tags(text, "link"):
        if "canonical" in attrs.get("rel", "").lower().split() and attrs.get("href"):
            url = paths.stable_canonical(scanner.decode_attribute(attrs["href"]), base)
            if url and url not in found:
                found.append(url)
    return (found[0] if len(found) == 1 else None), len(found) > 1


def managed_script(graph_text: str) -> str:
    return f'<script type="application/ld+json" {MANAGED}>{graph_text}</script>'


def without_managed(text: str) -> str:
    return scanner.remove_elements(text, "script", lambda a, _: MANAGED in a)


def with_managed(text: str, graph_text: str) -> str:
    """The page with this managed graph and no other."""
    return scanner.insert_into_head(without_managed(text), managed_script(graph_text))


def strip_markers(text: str, attribute: str) -> str:
    """The page without the scripts that carry an authored payload."""
    return scanner.remove_elements(text, "script", lambda a, _: attribute in a) if attribute in text else text


def marker(text: str, attribute: str) -> dict | None:
    """The first payload that is a JSON object, or null."""
    for tag in scanner.tags(text):
        if tag.name == "script" and not tag.closing and attribute in scanner.attributes(tag):
            try:
                value = G.loads(text[tag.end : tag.inner])
            except G.GraphError:
                continue
            if isinstance(value, dict):
                return value
    return None


def marker_payloads(text: str | None, attribute: str) -> tuple[dict | None, list[str], str | None]:
    """(payload, codes, page without markers): the first marker that is a JSON object counts.

    One that is no JSON object is ``marker-invalid``; a second good one ``marker-repeated``.
    """
    if text is None or attribute not in text:
        return None, [], text
    payload, codes, spans = None, [], []
    for tag in scanner.tags(text):
        if tag.name != "script" or tag.closing or attribute not in scanner.attributes(tag):
            continue
        spans.append((tag.start, tag.outer))
        try:
            value = G.loads(text[tag.end : tag.inner])
        except G.GraphError:
            value = None
        if not isinstance(value, dict):
            codes.append("marker-invalid")
        elif payload is None:
            payload = value
        else:
            codes.append("marker-repeated")
    return payload, codes, scanner.cut(text, spans)


def markers(html: Column, attribute: str) -> Column:
    """Struct (payload, codes, html) of pages' markers: payload as JSON, html without them."""

    def read(texts: pd.Series) -> pd.DataFrame:
        rows = [marker_payloads(None if t is None or t != t else t, attribute) for t in texts]
        return pd.DataFrame([(None if p is None else G.stable(p), c, h) for p, c, h in rows], columns=["payload", "codes", "html"])

    return F.pandas_udf(read, "payload string, codes array<string>, html string")(html)


def marked(pages: DataFrame, attribute: str) -> tuple[DataFrame, DataFrame]:
    """(pages with ``marker`` and html without markers, findings); of (site, pathname, html and more)."""
    rows = pages.withColumn("_m", markers(F.col("html"), attribute))
    found = rows.select("site", F.lit("head").alias("producer"), F.explode("_m.codes").alias("code"), F.lit("warning").alias("severity"), "pathname")
    return rows.withColumns({"marker": F.col("_m.payload"), "html": F.col("_m.html")}).drop("_m"), found


def breadcrumb_trail(text: str, page_url: str) -> list[dict] | None:
    """Links of the breadcrumb navigation, if there are two and they end at the page."""
    for nav in dom.select(dom.parse(text), 'nav[aria-label*="readcrumb"], [class~="breadcrumbs"], [class~="breadcrumb"]'):
        found = []
        for a in nav.elements():
            url = paths.stable_canonical(a.attrs.get("href"), page_url) if a.name == "a" else None
            if url and a.text().strip():
                found.append({"position": len(found) + 1, "name": " ".join(a.text().split()), "item": url})
        here = paths.stable_canonical(page_url)
        if len(found) > 1 and here and found[-1]["item"].rstrip("/") == here.rstrip("/"):
            return found
    return None


def inferred_entities(facts: dict) -> list[dict]:
    """WebSite, WebPage and breadcrumb entries that a page's facts imply."""
    site, page = facts.get("site_url"), facts.get("canonical")
    if not site or not page:
        return []
    guess = [{"source": "inference"}]
    of_site = {"@type": "WebSite", "@id": f"{site.rstrip('/')}/#website", "url": site} | ({"name": facts["site_name"]} if facts.get("site_name") else {})
    of_page = {"@type": "WebPage", "@id": f"{page}#webpage", "url": page, "isPartOf": {"@id": of_site["@id"]}}
    of_page |= {k: facts[f] for k, f in (("name", "title"), ("description", "description"), ("inLanguage", "language"), ("datePublished", "published"), ("dateModified", "modified")) if facts.get(f)}
    out = [{"entity": of_site, "roles": ["site"], "provenance": guess}, {"entity": of_page, "roles": ["page"], "provenance": guess}]
    if facts.get("trail"):
        items = [{"@type": "ListItem", **step} for step in facts["trail"]]
        crumbs = {"@type": "BreadcrumbList", "@id": f"{page}#breadcrumb", "itemListElement": items}
        of_page["breadcrumb"] = {"@id": crumbs["@id"]}
        out.append({"entity": crumbs, "roles": ["breadcrumbs"], "provenance": guess})
    return out


def delta(before: str, after: str, current: str) -> str | None:
    """Apply the one contiguous change from ``before`` to ``after`` to ``current``.

    Null if what was changed does not stand there exactly once.
    """
    if before == after:
        return current
    n = min(len(before), len(after))
    head = next((k for k in range(n) if before[k] != after[k]), n)
    tail = next((k for k in range(n - head) if before[-1 - k] != after[-1 - k]), n - head)
    old, new = before[head : len(before) - tail], after[head : len(after) - tail]
    if current == before:
        return after
    if not old or current.count(old) != 1:
        return None
    return current.replace(old, new)


def enrich(pages: DataFrame, alternate: str = "auto") -> DataFrame:
    """(site, pathname, html, canonical, canonical_conflict, entities, codes): enriched pages.

    Needs site, pathname, url, md_href, html, title, description, language.  ``head``,
    where there is such a column, is what a page states of itself (JSON, see
    :mod:`sitegrain.operators.explicit`): it comes before all else.  ``trail`` (array of
    name and item) is the catalog's way to the page, used where the page shows none.
    One pass in Python per page, in Arrow batches.
    """
    from . import explicit

    cols = ["site", "pathname", "url", "md_href", "html", "title", "description", "language", *[c for c in ("head", "trail") if c in pages.columns]]
    schema = "site string, pathname string, html string, canonical string, canonical_conflict boolean, entities array<string>, codes array<string>"

    def one(row: dict) -> dict:
        text, base, codes = row["html"] or "", paths.stable_canonical(row["url"]), []
        scope = paths.site_scope(f"https://{row['site']}")
        try:
            said = G.loads(row["head"]) if row.get("head") else {}
            said = said if isinstance(said, dict) else {}
        except G.GraphError:
            said, codes = {}, ["head-invalid"]
        found, conflict = canonical_of(text, base)
        own = explicit.explicit_canonical(said, base, scope)
        found, conflict = (own, False) if own else (found, conflict)
        text, more = explicit.state(text, said, found or base, scope)
        stated = {k: said[k] for k in ("title", "description") if isinstance(said.get(k), str)}
        facts = {k: row[k] for k in ("title", "description", "language")} | stated
        facts |= {"canonical": found or base, "site_url": scope, "site_name": row["site"]}
        facts["trail"] = breadcrumb_trail(text, row["url"] or "") or explicit.catalog_trail(row.get("trail"), found or base)
        written = [e for t in scanner.head_features(text)["scripts"] for e in G.authored(t)[0]]
        if "schema" in said:
            good, bad = G.authored(G.stable(said["schema"]))
            written, codes = written + good, codes + bad
        merged = G.merge([*written, *inferred_entities(facts)])
        text = with_alternate(fill_head(text, facts), row["md_href"] or "", alternate)
        text = with_managed(text, G.document(merged))
        return {"site": row["site"], "pathname": row["pathname"], "html": text, "canonical": found or base, "canonical_conflict": conflict, "entities": [G.stable(e["entity"]) for e in merged.entries], "codes": codes + more}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, texts = pa.string(), pa.list_(pa.string())
        arrow = pa.schema([("site", text), ("pathname", text), ("html", text), ("canonical", text), ("canonical_conflict", pa.bool_()), ("entities", texts), ("codes", texts)])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(row) for row in batch.to_pylist()], arrow)

    return pages.select(*cols).mapInArrow(run, schema)


def html_column(function, *args) -> object:
    """A pure text function as an Arrow-batched column function."""
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else function(t, *args))

    return F.pandas_udf(run, T.StringType())
