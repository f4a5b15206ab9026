"""Options of a site's publication, with defaults; checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from .functions.html.markdown import Options


@dataclass(frozen=True)
class Section:
    """A section of the text index: its title, and the globs of its pages or a predicate.

    ``where`` is a boolean column over the page rows, or a function of the rows'
    DataFrame that gives one; a Python predicate is a pandas UDF of columns.
    """

    title: str
    match: tuple[str, ...] = ()
    where: Any = None


@dataclass(frozen=True)
class Corpus:
    sections: tuple[Section, ...] = ()
    default_section: str | None = "Pages"
    include_html_only: bool = False
    descriptions: bool = True
    last_modified: bool = False
    full_mode: str = "all"
    max_pages: int | None = None

    def __post_init__(self) -> None:
        if self.full_mode not in ("all", "index", "first-page-only"):
            raise ValueError(f"unknown mode {self.full_mode!r}")


@dataclass(frozen=True)
class Robots:
    universal_allow: bool = True
    allow: tuple[str, ...] = ()
    disallow: tuple[str, ...] = ()
    sitemap_path: str | None = "/sitemap-index.xml"
    mention_index: bool = True
    extra: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    name: str = ""
    entity_type: str = "Organization"
    description: str = ""
    website: str = ""
    contact: str = ""
    logo: str = ""
    same_as: tuple[str, ...] = ()


@dataclass(frozen=True)
class Site:
    name: str = ""
    description: str = ""
    base: str = ""
    trailing_slash: str = "ignore"
    default_locale: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    respect_noindex: bool = True
    strip_title_suffix: tuple[str, ...] = ()
    frontmatter: bool = False
    show_modified: bool = False
    extraction: Options = field(default_factory=Options)
    corpus: Corpus = field(default_factory=Corpus)
    robots: Robots = field(default_factory=Robots)
    profile: Profile = field(default_factory=Profile)

    def __post_init__(self) -> None:
        if self.trailing_slash not in ("always", "never", "ignore"):
            raise ValueError(f"unknown trailing slash policy {self.trailing_slash!r}")

    def but(self, **changes) -> Site:
        return replace(self, **changes)
