"""URLs: native expressions for the common form, and a WHATWG-style resolver for the rest.

An address in plain form (http or https, lower-case ASCII host, nothing to escape, no dot segments) is its own
serialisation but for a default port or an empty path, which native expressions handle. Others go through the Arrow
function `serialise`, which passes plain addresses by without work.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siteloom.functions.text import trimmed

PLAIN = r"^https?://[a-z0-9._-]+(:[0-9]+)?(/[A-Za-z0-9._~!$&()*+,;=:@%/-]*)?(\?[A-Za-z0-9._~!$&()*+,;=:@%/?-]*)?(#[A-Za-z0-9._~!$&()*+,;=:@%/?-]*)?$"
DOTS = r"/\.{1,2}(/|\?|#|$)|%2[eE]"
#: Plain addresses that are their own and only alias: no port, fragment, escape, dot segment or white space, and a path below the root.
ALONE = r"^https?://[a-z0-9._-]++(?:/[A-Za-z0-9_~!$&()*+,;=:@-][A-Za-z0-9._~!$&()*+,;=:@-]*+)++/?(?:\?[A-Za-z0-9._~!$&()*+,;=:@?-]*+)?\z"
_DEFAULT = {"http": 80, "https": 443, "ftp": 21}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- the resolver, in Python


def _dots(path: str) -> str:
    """The path without . and .. segments, also where their dots are escaped."""
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, part in enumerate(parts):
        low = part.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def parse(text: str | None, base: str | None = None) -> tuple[str, str, int | None, str, str | None, str | None] | None:
    """(scheme, host, port, path, query, fragment) of an absolute http(s) address, relative ones against `base`; else None."""
    if text is None:
        return None
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", text)
    up = parse(base) if base else None
    if m and m.group(1).lower() not in ("http", "https"):
        return None
    body, _, fragment = text.partition("#")
    fragment = fragment if "#" in text else None
    body, mark, query = body.partition("?")
    query = query if mark else None
    body = body.replace("\\", "/")
    if m:
        scheme, rest = m.group(1).lower(), body[len(m.group(0)) :]
        if not rest.startswith("//") and up and up[0] == scheme:
            return _relative(rest, query, fragment, up)
        authority, slash, path = rest.lstrip("/").partition("/")
        path = slash + path
    elif up is None:
        return None
    elif body.startswith("//"):
        scheme = up[0]
        authority, slash, path = body[2:].lstrip("/").partition("/")
        path = slash + path
    else:
        return _relative(body, query, fragment, up)
    authority = authority.rpartition("@")[2]
    host, colon, port = authority.rpartition(":") if re.search(r":\d*$", authority) else (authority, "", "")
    try:
        host = host.encode("idna").decode().lower() if not host.isascii() else host.lower()
        number = int(port) if port else None
    except (UnicodeError, ValueError):
        return None
    if not host or re.search(r"[\s<>^|%\\\[\]{}\"]", host) or (number is not None and number > 65535):
        return None
    return scheme, host, None if number == _DEFAULT[scheme] else number, _escaped(_dots(path or "/"), "path"), _escaped(query, "query"), _escaped(fragment, "fragment")


def _relative(body, query, fragment, up):
    scheme, host, port, path, before, _ = up
    if body == "":
        return scheme, host, port, path, before if query is None else _escaped(query, "query"), _escaped(fragment, "fragment")
    if not body.startswith("/"):
        body = path.rpartition("/")[0] + "/" + body
    return scheme, host, port, _escaped(_dots(body), "path"), _escaped(query, "query"), _escaped(fragment, "fragment")


_SAFE = {"path": "!$%&'()*+,-./:;=@[]^_|~", "query": "!$%&()*+,-./:;=?@[\\]^_`{|}~", "fragment": "!$%&'()*+,-./:;=?@[\\]^_{|}~#"}


def _escaped(text: str | None, part: str) -> str | None:
    return None if text is None else quote(text, safe=_SAFE[part], errors="replace")


def joined(p: tuple | None, fragment: bool = True) -> str | None:
    if p is None:
        return None
    scheme, host, port, path, query, frag = p
    return f"{scheme}://{host}{'' if port is None else f':{port}'}{path}{'' if query is None else f'?{query}'}{'' if frag is None or not fragment else f'#{frag}'}"


def resolve_href(href: str | None, base: str) -> str | None:
    """The http(s) target of a link without fragment; empty, fragment-only and foreign-scheme links have none."""
    href = (href or "").strip()
    if not href or href.startswith("#") or re.match(r"(?i)(mailto|tel|javascript|data):", href):
        return None
    return joined(parse(href, base), fragment=False)


@F.pandas_udf(StringType())
def serialise(text: pd.Series) -> pd.Series:
    """Parsed serialisation of absolute http(s) addresses, null for what is none and for null."""
    return text.map(lambda t: None if t is None else joined(parse(t)))


@F.pandas_udf(StringType())
def resolve(href: pd.Series, base: pd.Series) -> pd.Series:
    """`resolve_href` over columns."""
    return pd.Series([resolve_href(h, b) if b else None for h, b in zip(href, base)])


# ---------------------------------------------------------------- native expressions over plain addresses


def is_plain(c: Column | str) -> Column:
    """Whether the address is in plain form."""
    c = _col(c)
    return F.coalesce(F.rlike(c, F.lit(PLAIN)) & ~F.rlike(c, F.lit(DOTS)), F.lit(False))


def scheme(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"^(https?)://", 1), F.lit(""))


def authority(c: Column | str) -> Column:
    """Host and port, without a default port."""
    c = _col(c)
    raw = F.regexp_extract(c, r"^https?://([^/?#]*)", 1)
    port = F.when(F.startswith(c, F.lit("https:")), r":443$").otherwise(r":80$")
    return F.regexp_replace(raw, port, F.lit(""))


def host(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"^https?://([^/?#:]*)", 1), F.lit(""))


def path(c: Column | str) -> Column:
    got = F.regexp_extract(_col(c), r"^https?://[^/?#]*([^?#]*)", 1)
    return F.when(got == "", "/").otherwise(got)


def query(c: Column | str) -> Column:
    """With its question mark; empty without."""
    return F.regexp_extract(_col(c), r"^[^?#]*(\?[^#]*)", 1)


def fragment(c: Column | str) -> Column:
    """With its hash sign; empty without."""
    return F.regexp_extract(_col(c), r"(#.*)$", 1)


def without_fragment(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"#.*$", "")


def plain_serialised(c: Column | str) -> Column:
    """The serialisation of a plain address."""
    c = _col(c)
    return F.concat(scheme(c), F.lit("://"), authority(c), path(c), query(c), fragment(c))


def is_alone(c: Column | str) -> Column:
    """Whether the address has no other alias than itself; tested by one expression, before all others."""
    return F.coalesce(F.rlike(_col(c), F.lit(ALONE)), F.lit(False))


def serialised(c: Column | str) -> Column:
    """The serialisation of any address: plain ones on the JVM; the Arrow function gets null in their place."""
    c = trimmed(c)
    odd = F.when(F.rlike(c, F.lit(r"(?i)^[\x00-\x20]*https?:")) & ~is_plain(c), c)  # whatever has another scheme is no address
    return F.coalesce(F.when(is_plain(c), plain_serialised(c)), serialise(odd))


def aliases_of(text: Column, parsed: Column) -> Column:
    """Distinct names that denote the same address: the trimmed text, its serialisation, that without fragment, and for the
    path / also without the slash. Null and blank text have none.
    """
    bare = without_fragment(parsed)
    root = F.when(path(bare) == "/", F.concat(scheme(bare), F.lit("://"), authority(bare), query(bare)))
    names = F.array_distinct(F.array_compact(F.array(F.nullif(trimmed(text), F.lit("")), parsed, bare, root)))
    return F.coalesce(names, F.array().cast("array<string>"))


def aliases(c: Column | str) -> Column:
    """`aliases_of` over plain addresses, all on the JVM; others only stand for their trimmed text.

    `with_aliases` serves all addresses.
    """
    c = _col(c)
    return aliases_of(c, F.when(is_plain(trimmed(c)), plain_serialised(trimmed(c))))


def with_aliases(df: DataFrame, columns: list[str], name: str = "alias") -> DataFrame:
    """`df` with one row per distinct alias of any of `columns` (rows without any are left out)."""
    return with_names(df, **{name: columns}).withColumn(name, F.explode(name))


def with_names(df: DataFrame, **columns: str | list[str]) -> DataFrame:
    """`df` with array columns of the distinct aliases of a column or of several: name=columns. Each address is parsed once, in
    a column of its own. Rows of addresses without a further alias are told by one expression each and are not parsed at all.
    """
    wanted = {n: [c] if isinstance(c, str) else c for n, c in columns.items()}
    parsed = {c: f"_parsed_{i}" for i, c in enumerate(dict.fromkeys(x for cs in wanted.values() for x in cs))}
    alone = reduce(lambda a, b: a & b, [F.col(c).isNull() | is_alone(c) for c in parsed])
    few = df.where(alone).withColumns({n: F.array_distinct(F.array_compact(F.array(*cs))) if len(cs) > 1 else F.when(F.col(cs[0]).isNull(), F.array().cast("array<string>")).otherwise(F.array(cs[0])) for n, cs in wanted.items()})
    rows = df.where(~alone).withColumns({p: serialised(c) for c, p in parsed.items()})
    rest = rows.withColumns({n: F.array_distinct(F.flatten(F.array(*[aliases_of(F.col(c), F.col(parsed[c])) for c in cs]))) for n, cs in wanted.items()}).drop(*parsed.values())
    return few.unionByName(rest)


def scheme_free(c: Column | str) -> Column:
    """An alias without its scheme, for sources that report hosts and paths only."""
    return F.regexp_replace(_col(c), r"^https?://", "//")


def final_key(c: Column | str) -> Column:
    """Serialisation without fragment of an http(s) address, else null."""
    return without_fragment(serialised(c))


def plain_final_key(c: Column | str) -> Column:
    """`final_key` on the JVM alone; null for an address that is not plain."""
    return F.when(is_plain(trimmed(c)), without_fragment(plain_serialised(trimmed(c))))


def list_position(c: Column | str) -> Column:
    """n of a key `list:<n>:<url>`, else null."""
    return F.nullif(F.regexp_extract(_col(c), r"^list:(\d+):", 1), F.lit("")).cast("int")


def request_url(key: Column | str, url: Column | str) -> Column:
    """The requested address of an occurrence without fragment: that in a list key, else the key, else the url."""
    key = _col(key)
    bare = F.regexp_replace(key, r"^list:\d+:", "")
    return without_fragment(F.coalesce(F.nullif(trimmed(bare), F.lit("")), trimmed(url)))


def normalised_query(c: Column | str, strip_all: bool = False, drop: list[str] = (), ordered: bool = True, most: int | None = None) -> Column:
    """The address without fragment and with its parameters dropped (`strip_all`, or whole names matching one of `drop`),
    sorted by name and value, and cut to the first `most`.
    """
    c = without_fragment(c)
    base = F.regexp_extract(c, r"^([^?]*)", 1)
    if strip_all:
        return base
    parts = F.filter(F.split(F.regexp_extract(c, r"\?(.*)$", 1), "&"), lambda p: p != "")
    name = lambda p: F.substring_index(p, "=", 1)
    if drop:
        dropped = F.lit("^(?:" + "|".join(f"(?:{p})" for p in drop) + ")$")
        parts = F.filter(parts, lambda p: ~F.rlike(name(p), dropped))
    if ordered:
        pairs = F.array_sort(F.transform(parts, lambda p: F.struct(name(p).alias("n"), F.substring(p, F.char_length(name(p)) + 1, F.char_length(p)).alias("v"))))
        parts = F.transform(pairs, lambda p: F.concat(p["n"], p["v"]))
    if most is not None:
        parts = F.slice(parts, 1, most)
    return F.when(F.size(parts) > 0, F.concat(base, F.lit("?"), F.array_join(parts, "&"))).otherwise(base)


def folders(c: Column | str) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path(c), "/"), lambda x: x != "")


def folder_depth(c: Column | str) -> Column:
    """Folders above the document: segments, without the last unless the path ends in a slash."""
    n = F.size(folders(c))
    return F.when(F.endswith(path(c), F.lit("/")), n).otherwise(F.greatest(n - 1, F.lit(0)))


def within_limits(c: Column | str, max_bytes: int = 0, max_folders: int = 0) -> Column:
    """Length in bytes and folder depth within the limits; 0 sets none."""
    c = _col(c)
    ok = F.lit(True)
    if max_bytes:
        ok = ok & (F.octet_length(c) <= max_bytes)
    if max_folders:
        ok = ok & (folder_depth(c) <= max_folders)
    return ok


# File endings by class of resource.
RESOURCE_CLASSES = {
    "image": ["jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "ico"],
    "css": ["css"],
    "javascript": ["js", "mjs"],
    "sitemap": ["xml"],
    "html": ["html", "htm", "php", "asp", "aspx", "jsp", "cfm"],
}


def resource_class(c: Column | str) -> Column:
    """What the ending of the path says: html (also without one), image, css, javascript, sitemap or other."""
    ending = F.lower(F.regexp_extract(path(c), r"\.([A-Za-z0-9]+)$", 1))
    got = F.when(ending == "", "html")
    for kind, endings in RESOURCE_CLASSES.items():
        got = got.when(ending.isin(endings), kind)
    return got.otherwise("other")


def in_scope(c: Column | str, root: str, subdomains: bool = False, folder: str | None = None, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Host (exact, or any below the root without www), folder prefix, any include pattern (none given: all), no exclude."""
    at = (urlsplit(root).hostname or "").lower()
    h = host(c)
    bare = at.removeprefix("www.")
    ok = ((h == bare) | F.endswith(h, F.lit("." + bare))) if subdomains else (h == at)
    if folder:
        ok = ok & F.startswith(path(c), F.lit(folder.rstrip("/") + "/"))
    if include:
        ok = ok & F.greatest(*[F.rlike(_col(c), F.lit(p)) for p in include], F.lit(False))
    for p in exclude:
        ok = ok & ~F.rlike(_col(c), F.lit(p))
    return F.coalesce(ok, F.lit(False))


# Public suffixes of two labels under which names are registered, besides every suffix of one label.
SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.mx", "com.ar", "com.tr", "com.cn", "co.in", "co.kr", "co.za", "com.sg", "com.hk", "com.tw"]


def registrable_domain(c: Column | str, suffixes: list[str] = SUFFIXES) -> Column:
    """The registered name of an address's host: its suffix (one label, or one of `suffixes`) and the label before it. Null for
    numeric hosts and for hosts that are a suffix themselves.
    """
    labels = F.split(F.rtrim(host(c), F.lit(".")), r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    n = F.when(two.isin(suffixes), 3).otherwise(2)
    name = F.when(F.size(labels) >= n, F.when(n == 3, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two))
    return F.when(F.size(labels) >= 2, F.when(~F.rlike(F.element_at(labels, -1), F.lit(r"^\d+$|[\[\]]")), name))


def on_cdn(c: Column | str, cdn_hosts: list[str]) -> Column:
    """Whether an address lies on one of the hosts, each a host or a host and the start of a path, with or without scheme."""
    ok = F.lit(False)
    for entry in cdn_hosts:
        at, _, below = re.sub(r"^https?://", "", entry.strip()).partition("/")
        at, below = at.rstrip(".").lower(), below.rstrip("/")
        if at:
            ok = ok | ((F.rtrim(host(F.lower(_col(c))), F.lit(".")) == at) & (F.startswith(F.ltrim(path(c), F.lit("/")), F.lit(below)) if below else F.lit(True)))
    return F.coalesce(ok, F.lit(False))


def is_internal(c: Column | str, root: str, scope: str = "exact", cdn_hosts: list[str] = ()) -> Column:
    """Host scope - exact, subdomains (of the root without www) or domain (all hosts of the root's registered name) - or a CDN
    host that counts as the site's own.
    """
    if scope == "domain":
        ok = (host(c) == (urlsplit(root).hostname or "").lower()) | (registrable_domain(c) == registrable_domain(F.lit(root)))
    else:
        ok = in_scope(c, root, subdomains=scope == "subdomains")
    return F.coalesce(ok, F.lit(False)) | on_cdn(c, list(cdn_hosts))


def may_crawl(c: Column | str, root: str, kinds: dict[str, bool], external: bool = False, scope: str = "exact", cdn_hosts: list[str] = ()) -> Column:
    """Whether a discovered address is fetched: internal ones (others only where `external`) of a class that `kinds` allows; a
    sitemap counts as other. The same decision with the kinds to keep tells whether a record is stored.
    """
    kind = resource_class(c)
    allowed = F.lit(False)
    for name, on in kinds.items():
        if on:
            allowed = allowed | ((kind == name) | (F.lit(name == "other") & (kind == "sitemap")))
    return allowed & (F.lit(True) if external else is_internal(c, root, scope, cdn_hosts))


def may_expand(url: Column | str, final_url: Column | str, root: str, folder: str | None, scope: str = "exact", cdn_hosts: list[str] = ()) -> Column:
    """Whether links of a page are followed where pages outside the start folder are only checked: both of its addresses must
    lie on the site and in the folder (no folder: always).
    """
    if not folder:
        return F.lit(True)
    inside = lambda c: is_internal(c, root, scope, cdn_hosts) & F.startswith(path(c), F.lit(folder))
    return F.coalesce(inside(url) & inside(final_url), F.lit(False))


def graph_label(c: Column | str) -> Column:
    """The path, or the host for a root."""
    return F.when(path(c) == "/", host(c)).otherwise(F.concat(path(c), query(c)))


def section(c: Column | str) -> Column:
    """Host and first path segment."""
    first = F.try_element_at(folders(c), F.lit(1))
    return F.concat(host(c), F.lit("/"), F.coalesce(first, F.lit("")))


def tree_paths(c: Column | str) -> Column:
    """All prefixes of the address as a tree: the origin, each folder below it, the document with its query."""
    c = _col(c)
    origin = F.concat(scheme(c), F.lit("://"), authority(c))
    parts = folders(c)
    below = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(origin, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array(F.concat(origin, F.lit("/"))))
    asked = F.when(query(c) != "", F.array(F.concat(F.element_at(below, -1), query(c)))).otherwise(F.array().cast("array<string>"))
    return F.when(scheme(c).isNotNull(), F.concat(F.array(origin), below, asked)).otherwise(F.array().cast("array<string>"))
