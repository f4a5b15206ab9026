"""Head metadata that a page states itself: whole families of tags are replaced by it.

A statement is a JSON object.  Each of its members speaks of a *family* of tags: what
the head has of the family goes, what the statement says comes, and families that it
does not mention stay as they are.  All removals are one pass over the head's tags.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Any

from ..functions import paths
from ..functions.html import scanner
from .heads import link, meta

_FEEDS = re.compile(r"rss|atom|feed\+json", re.I)
# Platforms of app cards, and the parts of an image.
_PLATFORMS = ("iphone", "ipad", "googleplay")
_IMAGE_PARTS = (("secure_url", "secureUrl"), ("type", "type"), ("width", "width"), ("height", "height"), ("alt", "alt"))

Tag = str
Statement = dict[str, Any]


def _rel(attrs: dict, name: str) -> bool:
    return name in attrs.get("rel", "").lower().split()


def _called(attrs: dict, key: str = "name") -> str:
    return attrs.get(key, "").lower()


#: What belongs to each family: (element, attributes) -> bool.
FAMILIES: dict[str, Callable[[str, dict], bool]] = {
    "title": lambda n, a: n == "title",
    "description": lambda n, a: n == "meta" and _called(a) == "description",
    "canonical": lambda n, a: n == "link" and _rel(a, "canonical"),
    "robots": lambda n, a: n == "meta" and _called(a) == "robots",
    "openGraph": lambda n, a: n == "meta" and _called(a, "property").startswith("og:"),
    "twitter": lambda n, a: n == "meta" and _called(a).startswith("twitter:"),
    "hreflang": lambda n, a: n == "link" and _rel(a, "alternate") and "hreflang" in a,
    "feeds": lambda n, a: n == "link" and _rel(a, "alternate") and bool(_FEEDS.search(a.get("type", ""))),
    "pagination": lambda n, a: n == "link" and (_rel(a, "prev") or _rel(a, "next")),
    "markdownAlternate": lambda n, a: n == "link" and _rel(a, "alternate") and a.get("type", "").lower() == "text/markdown",
    "themeColor": lambda n, a: n == "meta" and _called(a) == "theme-color",
    "authors": lambda n, a: (n == "meta" and _called(a) == "author") or (n == "link" and _rel(a, "author")),
    "locale": lambda n, a: n == "meta" and _called(a, "property") == "og:locale",
}


class _Writer:
    """Tags of one page's statement."""

    def __init__(self, said: Statement, canonical: str | None, site_url: str | None):
        self.said, self.canonical, self.base = said, canonical, canonical or site_url

    def url(self, value: Any) -> str | None:
        return paths.stable_canonical(value, self.base) if isinstance(value, str) and value else None

    @staticmethod
    def _list(value: Any) -> list:
        return [] if value is None else value if isinstance(value, list) else [value]

    @staticmethod
    def _named(pairs: list[tuple[str, Any]]) -> list[Tag]:
        return [meta(k, v) for k, v in pairs if isinstance(v, str)]

    def _images(self) -> list[dict]:
        graph = self.said.get("openGraph")
        listed = self._list(graph.get("images")) if isinstance(graph, dict) else []
        return [{"url": i} if isinstance(i, str) else i for i in listed if isinstance(i, (str, dict))]

    def title(self) -> list[Tag]:
        text = self.said["title"].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return [f"<title>{text}</title>"]

    def description(self) -> list[Tag]:
        return [meta("description", self.said["description"])]

    def canonical_link(self) -> list[Tag]:
        return [link("canonical", self.canonical)] if self.canonical else []

    def robots(self) -> list[Tag]:
        value = self.said["robots"]
        value = ", ".join(map(str, value)) if isinstance(value, list) else value
        return [meta("robots", value)] if isinstance(value, str) else []

    def open_graph(self) -> list[Tag]:
        graph, said = self.said["openGraph"], self.said
        pairs = [("type", graph.get("type")), ("title", graph.get("title", said.get("title"))), ("description", graph.get("description", said.get("description"))), ("url", self.url(graph.get("url")) or self.canonical), ("site_name", graph.get("siteName")), ("locale", said.get("locale"))]
        out = self._named([(f"og:{k}", v) for k, v in pairs])
        for image in self._images():
            if address := self.url(image.get("url")):
                out.append(meta("og:image", address))
                for part, key in _IMAGE_PARTS:
                    value = self.url(image.get(key)) if part == "secure_url" else image.get(key)
                    if value is not None:
                        out.append(meta(f"og:image:{part}", f"{value:g}" if isinstance(value, float) else str(value)))
        return out + self._named([("og:locale:alternate", v) for v in self._list(graph.get("localeAlternates"))])

    def twitter(self) -> list[Tag]:
        own, said = self.said["twitter"], self.said
        graph = said["openGraph"] if isinstance(said.get("openGraph"), dict) else {}
        first = self._images()[:1]
        inherit = lambda key: next((x[key] for x in (own, graph, said) if x.get(key) is not None), None)
        picture = own.get("image") or (first[0].get("url") if first else None)
        pairs = [("card", own.get("card")), ("site", own.get("site")), ("site:id", own.get("siteId")), ("creator", own.get("creator")), ("creator:id", own.get("creatorId")), ("title", inherit("title")), ("description", inherit("description")), ("image", self.url(picture)), ("image:alt", own.get("imageAlt"))]
        player = own.get("player") if isinstance(own.get("player"), dict) else {}
        size = lambda v: f"{v:g}" if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else None
        pairs += [("player", self.url(player.get("url"))), ("player:width", size(player.get("width"))), ("player:height", size(player.get("height"))), ("player:stream", self.url(player.get("stream")))]
        for app in self._list(own.get("apps")):
            if isinstance(app, dict) and app.get("platform") in _PLATFORMS:
                pairs += [(f"app:{key}:{app['platform']}", self.url(app.get("url")) if key == "url" else app.get(key)) for key in ("name", "id", "url")]
        return self._named([(f"twitter:{k}", v) for k, v in pairs])

    def hreflang(self) -> list[Tag]:
        return [link("alternate", u, hreflang=x["lang"]) for x in self.said["hreflang"] if isinstance(x, dict) and isinstance(x.get("lang"), str) and x["lang"] and (u := self.url(x.get("href")))]

    def feeds(self) -> list[Tag]:
        more = lambda x: {"title": x["title"]} if x.get("title") else {}
        return [link("alternate", u, type=x["type"], **more(x)) for x in self.said["feeds"] if isinstance(x, dict) and isinstance(x.get("type"), str) and (u := self.url(x.get("href")))]

    def pagination(self) -> list[Tag]:
        return [link(rel, u) for rel, key in (("prev", "previous"), ("next", "next")) if (u := self.url(self.said["pagination"].get(key)))]

    def markdown(self) -> list[Tag]:
        value = self.said["markdownAlternate"]
        value = value if isinstance(value, dict) else {"href": value}
        address = self.url(value.get("href"))
        more = {"title": value["title"]} if isinstance(value.get("title"), str) and value["title"] else {}
        return [link("alternate", address, type="text/markdown", **more)] if address else []

    def colours(self) -> list[Tag]:
        out = []
        for value in self._list(self.said["themeColor"]):
            value = {"color": value} if isinstance(value, str) else value
            if isinstance(value, dict) and isinstance(value.get("color"), str):
                media = value.get("media")
                out.append(meta("theme-color", value["color"], **({"media": media} if isinstance(media, str) and media else {})))
        return out

    def authors(self) -> list[Tag]:
        out = []
        for value in self._list(self.said["authors"]):
            value = {"name": value} if isinstance(value, str) else value
            if isinstance(value, dict) and isinstance(value.get("name"), str):
                out.append(meta("author", value["name"]))
                out += [link("author", u)] if (u := self.url(value.get("url"))) else []
        return out

    def locale(self) -> list[Tag]:
        return [meta("og:locale", self.said["locale"])]


_SAY: dict[str, tuple[Callable[[_Writer], list[Tag]], Callable[[Any], bool]]] = {
    "title": (_Writer.title, lambda v: isinstance(v, str)), "description": (_Writer.description, lambda v: isinstance(v, str)), "canonical": (_Writer.canonical_link, lambda v: v is not None),
    "robots": (_Writer.robots, lambda v: v is not None), "openGraph": (_Writer.open_graph, lambda v: isinstance(v, dict)), "twitter": (_Writer.twitter, lambda v: isinstance(v, dict)), "hreflang": (_Writer.hreflang, lambda v: isinstance(v, list)),
    "feeds": (_Writer.feeds, lambda v: isinstance(v, list)), "pagination": (_Writer.pagination, lambda v: isinstance(v, dict)), "markdownAlternate": (_Writer.markdown, lambda v: v is not None), "themeColor": (_Writer.colours, lambda v: v is not None),
    "authors": (_Writer.authors, lambda v: v is not None), "locale": (_Writer.locale, lambda v: isinstance(v, str)),
}


def explicit_canonical(said: Statement, page_url: str | None, site_url: str | None) -> str | None:
    """The canonical URL that a statement names, null if it names none or an unsafe one."""
    value = said.get("canonical")
    return paths.stable_canonical(value, page_url or site_url) if isinstance(value, str) and value else None


def state(text: str, said: Statement, canonical: str | None, site_url: str | None) -> tuple[str, list[str]]:
    """(page, finding codes): the head with the statement's families in place of its own."""
    codes = []
    if "author" in said and "authors" not in said:
        said = said | {"authors": said["author"]}
    if "locale" in said and not isinstance(said["locale"], str):
        codes.append("head-locale-invalid")
    writer = _Writer(said, canonical, site_url)
    gone, tags = [], []
    for family, (say, fits) in _SAY.items():
        if family not in said or not fits(said[family]) or (family == "canonical" and not canonical):
            continue
        if family == "locale" and isinstance(said.get("openGraph"), dict):
            continue  # it is among the Open Graph tags
        gone.append(FAMILIES[family])
        tags += say(writer)
    if not gone:
        return text, codes
    spans = [(t.start, t.outer if t.name == "title" else t.end) for t, a in scanner.head_tags(text) if any(test(t.name, a) for test in gone)]
    return scanner.insert_into_head(scanner.cut(text, spans), "".join(tags)), codes


def catalog_trail(steps: list[dict] | None, canonical: str | None) -> list[dict] | None:
    """A catalog's way to a page as breadcrumb steps, if it has two and ends at the page."""
    found = []
    for step in steps or ():
        name, item = (step.get("name") or "").strip(), paths.stable_canonical(step.get("item"))
        if name and item:
            found.append({"position": len(found) + 1, "name": name, "item": item})
    if len(found) < 2 or not canonical or found[-1]["item"].partition("#")[0] != canonical.partition("#")[0]:
        return None
    found[-1]["item"] = canonical
    return found
