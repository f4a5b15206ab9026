"""Paths and URLs as Spark columns, and the pure functions behind them.

Everything that plain SQL can say is a column expression.  Percent-decoding with
its safety limits and URL normalisation need a parser: those are pure functions
(``inspect_path``, ``parse_url``) with a vectorised wrapper each.

Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A path may be percent-encoded so often at most, counting its plain form.
MAX_FORMS = 3


def _vectorised(function: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A pure function of one or more strings as an Arrow-batched column."""

    def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series([function(*xs) for xs in zip(first, *rest, strict=True)], dtype=object)

    return F.pandas_udf(run, kind)


# -- native ------------------------------------------------------------------


def normalize_path(path: Column) -> Column:
    """A leading slash, and no trailing one but for the root."""
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    slash = (F.length(rooted) > 1) & F.endswith(rooted, F.lit("/"))
    return F.when(slash, F.left(rooted, F.length(rooted) - 1)).otherwise(rooted)


def glob_to_regex(glob: str) -> str:
    """A glob as a Java regular expression over the whole path.

    ``*`` stays in a segment, ``**`` crosses segments (``**/`` may be nothing),
    ``?`` is one character of a segment, ``[..]`` a class (``[!..]`` negated); a
    trailing ``/**`` also matches what stands before it.
    """
    body, tail = (glob[:-3], "(?:/.*)?") if glob.endswith("/**") else (glob, "")
    token = re.compile(r"\*\*/|\*\*|\*|\?|\[(?P<class>[^\]]*)\]?|(?P<text>[^*?\[]+)")
    fixed = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = []
    for m in token.finditer(body):
        if m["text"] is not None:
            out.append(re.sub(r"([\\^$.+()\[\]{}|])", r"\\\1", m["text"]))
        elif m["class"] is not None:
            negated = m["class"][:1] in ("!", "^")
            inside = re.sub(r"([\\^$.*+?()\[\]{}|&])", r"\\\1", m["class"][negated:])
            out.append("[" + "^" * negated + inside + "]")
        else:
            out.append(fixed[m[0]])
    # \z and not $: Java's $ also matches before a last line break.
    return rf"\A{''.join(out)}{tail}\z"


def match_path(path: Column, globs: str | Sequence[str]) -> Column:
    """Whether a path, normalised, matches any of the globs."""
    globs = [globs] if isinstance(globs, str) else list(globs)
    if not globs:
        return F.lit(False)
    plain = [g if "*" in g else "/" + g.strip("/") if g.strip("/") else "/" for g in globs]
    return normalize_path(path).rlike("|".join(f"(?:{glob_to_regex(g)})" for g in plain))


def is_included(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Included by a glob (all paths, if there is none) and excluded by none."""
    return match_path(path, include or ["**"]) & ~match_path(path, exclude)


def base_prefix(base: Column | str | None) -> Column:
    """A site's base without its trailing slash; the root is empty."""
    base = F.lit(base or "") if base is None or isinstance(base, str) else F.coalesce(base, F.lit(""))
    return F.when(base.isin("", "/"), "").otherwise(F.regexp_replace(base, r"/\z", ""))


def url_path(path: Column, trailing_slash: Column | str = "ignore") -> Column:
    """The path as the site serves it: with a slash at its end unless ``never``."""
    mode = F.lit(trailing_slash) if isinstance(trailing_slash, str) else trailing_slash
    return F.when((path == "/") | (mode == "never"), path).otherwise(F.concat(path, F.lit("/")))


def absolute_url(origin: Column, base: Column | str, path: Column, trailing_slash: Column | str = "ignore") -> Column:
    return F.concat(origin, base_prefix(base), url_path(path, trailing_slash))


def md_pathname(path: Column) -> Column:
    """Where the Markdown copy of a page is."""
    return F.when(path == "/", "/index.md").otherwise(F.concat(path, F.lit(".md")))


def md_href(path: Column, base: Column | str = "") -> Column:
    return F.concat(base_prefix(base), md_pathname(path))


def page_of_md(path: Column) -> Column:
    """The page of a Markdown copy; null if it is none."""
    return F.when(path == "/index.md", "/").when(
        F.endswith(path, F.lit(".md")), normalize_path(F.left(path, F.length(path) - 3))
    )


def strip_base(path: Column, base: Column | str) -> Column:
    """The path under the base; null if it is not under it."""
    prefix = base_prefix(base)
    return F.when(prefix == "", path).when(path == prefix, "/").when(
        F.startswith(path, F.concat(prefix, F.lit("/"))), F.substring(path, F.length(prefix) + 1, F.length(path))
    )


def with_base(path: Column, base: Column | str) -> Column:
    prefix = base_prefix(base)
    under = (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))
    return F.when((prefix == "") | under, path).otherwise(F.concat(prefix, path))


def without_base(path: Column, base: Column | str) -> Column:
    return F.coalesce(strip_base(path, base), path)


def file_of_page(path: Column, directories: bool = True) -> Column:
    """File of a page in a build; error pages are always flat."""
    flat = F.concat(path, F.lit(".html"))
    return F.when(path == "/", "/index.html").when(path.isin("/404", "/500"), flat).otherwise(
        F.concat(path, F.lit("/index.html")) if directories else flat
    )


def page_of_file(path: Column) -> Column:
    """The page that a built HTML file holds."""
    return normalize_path(F.regexp_replace(F.regexp_replace(path, r"\.html\z", ""), r"(\A|/)index\z", "$1"))


def ancestors(path: Column) -> Column:
    """All ancestors of a path from the root to itself, in order."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.concat(
        F.array(F.lit("/")),
        F.transform(parts, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/"))),
    )


def folder(path: Column) -> Column:
    """What has as :func:`ancestors` those of a path but for the path itself; null for the root.

    The folder where the path is one that ``ancestors`` gives, else (as ``/a//b`` or
    ``a``) the path as it is.
    """
    plain = path.startswith("/") & ~path.endswith("/") & ~path.contains("//")
    return F.when(path == "/", None).when(plain, F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)).otherwise(path)


def is_loopback(host: Column) -> Column:
    """localhost and its subdomains, 127/8, ``::1``, ``::``, and what maps there."""
    h = F.regexp_replace(F.regexp_replace(F.lower(host), r"\A\[|\]\z", ""), r"\.\z", "")
    v4 = r"127(\.\d{1,3}){3}"
    return h.isin("localhost", "::1", "::", "0.0.0.0") | h.rlike(
        rf"\.localhost\z|\A{v4}\z|\A::ffff:({v4}|0\.0\.0\.0|7f[0-9a-f]{{2}}:[0-9a-f]{{1,4}})\z"
    )


def looks_like_url(text: Column) -> Column:
    """A scheme, or a start that only a reference has, and no white space."""
    return ~text.rlike(r"\s") & text.rlike(r"\A([A-Za-z][A-Za-z0-9+.\-]*:|//|/|\./|\.\./|#|\?)")


def is_unsafe_protocol(text: Column) -> Column:
    """A scheme other than http, https, mailto and tel, control characters aside."""
    scheme = F.lower(F.regexp_extract(F.regexp_replace(text, r"[\x00-\x20\x7f]", ""), r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return (scheme != "") & ~scheme.isin("http", "https", "mailto", "tel")


def same_path(one: Column, two: Column) -> Column:
    """Whether two paths are one when normalised; a missing one equals nothing."""
    return F.coalesce(normalize_path(one) == normalize_path(two), F.lit(False))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*\z", "")


def document_key(url: Column) -> Column:
    """What two URLs of one document agree in: no fragment, no trailing slash."""
    return F.regexp_replace(without_fragment(url), r"/\z", "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def site_and_path(url: Column) -> tuple[Column, Column]:
    """Site (the host) and normalised path of a page URL."""
    path = path_of(url)
    return host_of(url), normalize_path(F.when(path == "", "/").otherwise(path))


# -- percent-encoded paths -----------------------------------------------------

_BAD_CHARACTER = re.compile(r"[\\?#\x00-\x1f\x7f]")
_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}")


def _decoded(text: str) -> str | None:
    """Percent-decoded as UTF-8; null if an escape is incomplete or not UTF-8."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return None
    try:
        return unquote_to_bytes(text).decode("utf-8")
    except UnicodeDecodeError:
        return None


def inspect_path(path: str | None) -> str | None:
    """The path decoded once, or null if it is not a safe root-relative path.

    In none of its decoded forms may it start with ``//``, hold a control
    character, ``\\``, ``?`` or ``#``, or have a dot segment; decoding must not
    make a new segment, and must end after two rounds.
    """
    if not isinstance(path, str) or not path.startswith("/"):
        return None

    def safe(form: str) -> bool:
        return not (form.startswith("//") or _BAD_CHARACTER.search(form) or {".", ".."} & set(form.split("/")))

    if not safe(path):
        return None
    once = _decoded(path)
    if once is None or once.count("/") != path.count("/"):
        return None
    form = once
    for _ in range(MAX_FORMS - 2):
        if form == path or not _ESCAPE.search(form):
            break
        if not safe(form):
            return None
        twice = _ESCAPE.sub(lambda m: chr(int(m[0][1:], 16)), form)
        if twice.count("/") != form.count("/"):
            return None
        form = twice
    if not safe(form) or (form != path and _ESCAPE.search(form)):
        return None
    return once


def catalog_path(path: str | None) -> str | None:
    """A catalog's path, normalised; null if it is unsafe."""
    if inspect_path(path) is None:
        return None
    return path[:-1] if len(path) > 1 and path.endswith("/") else path


_KEEP = "!#$&'()*+,-./:;=?@_~ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def encode_path(path: str) -> str:
    """Percent-encode what a path may not hold, as UTF-8."""
    return "".join(c if c in _KEEP else "".join(f"%{b:02X}" for b in c.encode()) for c in path)


def exact_path(path: str | None) -> dict | None:
    """The one encoded spelling of an artifact path and its decoded key, or null.

    Escapes are needed exactly where :func:`encode_path` makes them.
    """
    key = inspect_path(path)
    if key is None or encode_path(key) != path or path == "/":
        return None
    return {"path": path, "key": key}


inspect_path_column = _vectorised(inspect_path, T.StringType())
catalog_path_column = _vectorised(catalog_path, T.StringType())
exact_path_column = _vectorised(lambda p: (exact_path(p) or {}).get("path"), T.StringType())


# -- URLs ----------------------------------------------------------------------

_PORTS = {"http": "80", "https": "443"}


def _host(host: str) -> str | None:
    host = host.lower()
    if not host or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|]", host.strip("[]") if host.startswith("[") else host) and not host.startswith("["):
        return None
    try:
        return host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None


def _segments(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        plain = re.sub("%2e", ".", part, flags=re.I)
        if plain == "..":
            out = out[:-1]
        if plain in (".", ".."):
            out += [""] if last else []
        else:
            out.append(part)
    return "/" + "/".join(out)


def _escaped(text: str, more: str) -> str:
    return "".join(c if 0x20 < ord(c) < 0x7F and c not in more else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def parse_url(text: str | None, base: str | None = None) -> dict | None:
    """Scheme, user, host, port, path, query and fragment of an absolute URL.

    http and https URLs are normalised: lower-case scheme and host, no default
    port, dot segments resolved, what must be escaped escaped.  A relative
    reference needs an http(s) ``base``.  Null if it is not a URL.
    """
    if not isinstance(text, str):
        return None
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):(.*)\Z", text, re.S)
    scheme = m[1].lower() if m else None
    if scheme and scheme not in _PORTS:
        body, _, fragment = m[2].partition("#")
        return {"scheme": scheme, "user": "", "host": "", "port": "", "path": body, "query": None, "fragment": fragment if "#" in m[2] else None}
    up = parse_url(base) if base else None
    if m:
        rest = m[2].replace("\\", "/") if "?" not in m[2] and "#" not in m[2] else m[2]
        if not rest.startswith("/") and up and up["scheme"] == scheme:
            rest = text[len(m[1]) + 1 :]
            m = None
        else:
            rest = "//" + rest.lstrip("/")
    else:
        rest = text
    if not m and not up:
        return None
    rest, hash_, fragment = rest.partition("#")
    rest, mark, query = rest.partition("?")
    rest = rest.replace("\\", "/")
    out = {"scheme": scheme or up["scheme"], "user": "", "port": "", "fragment": _escaped(fragment, '"<>`') if hash_ else None, "query": _escaped(query, "\"<>'") if mark else None}
    if rest.startswith("//"):
        authority, slash, path = rest[2:].partition("/")
        user, at, place = authority.rpartition("@")
        host, colon, port = (place, "", "") if place.endswith("]") else place.rpartition(":") if ":" in place else (place, "", "")
        if port and not (port.isdigit() and int(port) < 65536):
            return None
        host = _host(host)
        if host is None:
            return None
        out |= {"user": user if at else "", "host": host, "port": "" if port == _PORTS[out["scheme"]] or not port else str(int(port)), "path": _segments("/" + path)}
    else:
        out |= {"host": up["host"], "port": up["port"], "user": up["user"]}
        if not rest:
            out["path"] = up["path"]
            if not mark:
                out["query"] = up["query"]
        else:
            out["path"] = _segments(rest if rest.startswith("/") else up["path"].rpartition("/")[0] + "/" + rest)
    out["path"] = _escaped(out["path"], '"<>`{}')
    return out


def format_url(url: dict, fragment: bool = True) -> str:
    if url["scheme"] not in _PORTS:
        tail = url["path"]
        return f"{url['scheme']}:{tail}" + (f"#{url['fragment']}" if fragment and url["fragment"] is not None else "")
    port = f":{url['port']}" if url["port"] else ""
    user = f"{url['user']}@" if url["user"] else ""
    query = f"?{url['query']}" if url["query"] is not None else ""
    return f"{url['scheme']}://{user}{url['host']}{port}{url['path']}{query}" + (f"#{url['fragment']}" if fragment and url["fragment"] is not None else "")


_LOOPBACK = re.compile(r"(?:.+\.)?localhost|127(?:\.\d{1,3}){3}|::1|::|0\.0\.0\.0|::ffff:(?:127(?:\.\d{1,3}){3}|0\.0\.0\.0|7f[0-9a-f]{2}:[0-9a-f]{1,4})")


def is_local(host: str) -> bool:
    return bool(_LOOPBACK.fullmatch(host.lower().strip("[]").removesuffix(".")))


def stable_canonical(text: str | None, base: str | None = None) -> str | None:
    """A public http(s) URL, normalised and without its fragment, or null."""
    url = parse_url(text, base)
    if not url or url["scheme"] not in _PORTS or url["user"] or is_local(url["host"]):
        return None
    return format_url(url, fragment=False)


def entity_id(text: str | None, base: str | None = None) -> str | None:
    """An entity's identifier as an absolute URL; null if it is unsafe or local."""
    if not isinstance(text, str) or not text or re.search(r"[\x00-\x1f\x7f]", text):
        return None
    url = parse_url(text, base)
    if not url or url["scheme"] in ("data", "file", "javascript", "vbscript") or url["user"] or (url["host"] and is_local(url["host"])):
        return None
    return format_url(url)


def configured_canonical(site_url: str | None, base: str | None, path: str | None, trailing_slash: str | None = "ignore") -> str | None:
    """A page's canonical URL from its site and path."""
    origin = stable_canonical(site_url)
    if not origin or path is None:
        return None
    prefix = "" if base in (None, "", "/") else base.removesuffix("/")
    route = path if path == "/" or trailing_slash == "never" else path + "/"
    return stable_canonical(prefix + route, origin)


def site_scope(site_url: str | None, base: str | None = None) -> str | None:
    """The URL under which a site's own documents are."""
    origin = stable_canonical(site_url)
    prefix = "" if base in (None, "", "/") else "/" + base.strip("/")
    return stable_canonical(prefix + "/", origin) if origin else None


def within_site(url: str | None, scope: str | None) -> bool:
    """Same origin, and a path under the scope's."""
    a, b = parse_url(url), parse_url(scope)
    if not a or not b or any(a[k] != b[k] for k in ("scheme", "host", "port")):
        return False
    root = b["path"].rstrip("/")
    return a["path"] == root or a["path"].startswith(root + "/")


stable_canonical_column = _vectorised(stable_canonical, T.StringType())
entity_id_column = _vectorised(entity_id, T.StringType())
configured_canonical_column = _vectorised(configured_canonical, T.StringType())
site_scope_column = _vectorised(site_scope, T.StringType())
within_site_column = _vectorised(within_site, T.BooleanType())
