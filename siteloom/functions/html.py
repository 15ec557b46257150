"""HTML documents as signals: a tree on the standard parser, the signals of one page, selectors, extraction and search."""

from __future__ import annotations

import json
import re
import struct
from html.parser import HTMLParser
from urllib.parse import urlsplit

from siteloom.functions import url as U

# Element names, the limits and fonts of estimates, fields that structured data must have, glyph widths.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
DEPRECATED = frozenset(
    ["acronym", "applet", "basefont", "big", "blink", "center", "dir", "font", "frame", "frameset", "isindex", "listing", "marquee", "noframes", "plaintext", "strike", "tt", "xmp"]
)
UNSEEN = frozenset(["head", "script", "style", "noscript", "template"])
ALT_MAX = 125
TITLE_FONT, DESCRIPTION_FONT = 18.0, 13.0
REQUIRED = {
    "Article": ["headline", "author", "datePublished"],
    "BlogPosting": ["headline", "author", "datePublished"],
    "NewsArticle": ["headline", "author", "datePublished"],
    "Product": ["name"],
    "Offer": ["price", "priceCurrency", "availability"],
    "BreadcrumbList": ["itemListElement"],
    "Organization": ["name"],
    "LocalBusiness": ["name"],
    "WebSite": ["name", "url"],
    "FAQPage": ["mainEntity"],
    "HowTo": ["name", "step"],
    "VideoObject": ["name", "thumbnailUrl", "uploadDate"],
    "Event": ["name", "startDate", "location"],
    "Recipe": ["name", "recipeIngredient", "recipeInstructions"],
}
NO_CONTEXT = ("warning", "JSON-LD entity is missing @context")
FOREIGN_CONTEXT = ("warning", "JSON-LD @context does not reference schema.org")
NO_TYPE = ("error", "JSON-LD entity is missing @type")
NO_FIELD = ("error", "{kind} is missing required field {field}")
NO_ENTITY = ("error", "JSON-LD block {n} does not contain an object entity")
NO_JSON = ("error", "JSON-LD block {n} is not valid JSON: {error}")
#: Estimated glyph widths in ems, by groups of characters; the first group that has a character counts.
WIDTHS = (
    (" \t", 0.28),
    ("ijlI!|',.:;", 0.26),
    ("frt()[]{}", 0.34),
    ("mwMW@%&", 0.82),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.64),
    ("0123456789", 0.56),
    ("-_/\\", 0.42),
    ("\"#$*+<=>?^`~", 0.5),
    ("abcdefghijklmnopqrstuvwxyz", 0.52),
)
_GLYPHS = {c: w for chars, w in reversed(WIDTHS) for c in chars}
# An open element that the start of another ends, and where the search for it stops.
_ENDS = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_FENCES = frozenset("ul ol dl table select body html div section article td th".split())


def _single(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def pixel_width(text: str | None, font: float) -> int:
    """Estimated width of a text line, summed in single precision."""
    total = 0.0
    for c in text or "":
        total = _single(total + _single(_single(_GLYPHS.get(c, 0.56 if c.isascii() else 1.0)) * font))
    return int(total + 0.5)


def spaced(text: str) -> str:
    return " ".join(text.split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "inert")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.inert = tag in ("svg", "math") or (parent is not None and (parent.inert or parent.tag == "template"))

    def walk(self):
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def texts(self, skip: frozenset[str] = frozenset()):
        stack: list = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in skip:
                stack.extend(reversed(n.children))

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        return spaced(" ".join(self.texts(skip)))

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)
        self.doctype = False

    def handle_decl(self, decl):
        self.doctype |= decl.lower().split()[:2] == ["doctype", "html"]

    def handle_starttag(self, tag, attrs):
        n = self.at
        while n.parent is not None and n.tag not in _FENCES:
            if tag in _ENDS.get(n.tag, ()):
                self.at = n.parent
                break
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.inert:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str | None) -> tuple[Node, bool]:
    """(document, whether it has an HTML doctype). Unclosed and cut markup gives the tree of what there is."""
    b = _Builder()
    b.feed(markup or "")
    b.close()
    return b.root, b.doctype


# ---------------------------------------------------------------- selectors

_STEP = re.compile(r"\s*([>+~]?)\s*([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+|\[[^\]]+\]|:[\w-]+(?:\([^)]*\))?)*)")
_PART = re.compile(r"([#.])([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*[\"']?([^\"'\]]*)[\"']?\s*(i)?)?\s*\]|:([\w-]+)(?:\(([^)]*)\))?")


def compile_selector(text: str) -> list[list[tuple]]:
    """Alternatives of steps (combinator, tag, parts) of a selector of types, ids, classes, attributes, :first-child,
    :last-child, :nth-child(n) and the descendant and child combinators; other selectors raise ValueError.
    """
    out = []
    for one in text.split(","):
        steps, at = [], 0
        one = one.strip()
        while at < len(one):
            m = _STEP.match(one, at)
            if not m or m.end() == at or m.group(1) in ("+", "~") or not (m.group(2) or m.group(3)):
                raise ValueError(f"selector {text!r}")
            parts = [(kind or None, name, attr, op, value, fold, pseudo, arg) for kind, name, attr, op, value, fold, pseudo, arg in _PART.findall(m.group(3))]
            steps.append((m.group(1) or " ", (m.group(2) or "*").lower(), parts))
            at = m.end()
        if not steps:
            raise ValueError(f"selector {text!r}")
        out.append(steps)
    return out


def _fits(n: Node, tag: str, parts: list) -> bool:
    if tag not in ("*", n.tag):
        return False
    for kind, name, attr, op, value, fold, pseudo, arg in parts:
        if kind == "#":
            ok = n.get("id") == name
        elif kind == ".":
            ok = name in (n.get("class") or "").split()
        elif attr:
            have = n.get(attr.lower())
            if have is None:
                return False
            if fold:
                have, value = have.lower(), value.lower()
            ok = {"": True, "=": have == value, "~=": value in have.split(), "|=": have == value or have.startswith(value + "-"), "^=": bool(value) and have.startswith(value), "$=": bool(value) and have.endswith(value), "*=": bool(value) and value in have}[op]
        else:
            peers = [c for c in n.parent.children if isinstance(c, Node)] if n.parent else [n]
            if pseudo == "first-child":
                ok = peers[0] is n
            elif pseudo == "last-child":
                ok = peers[-1] is n
            elif pseudo == "nth-child" and arg.isdigit():
                ok = len(peers) >= int(arg) and peers[int(arg) - 1] is n
            else:
                raise ValueError(f"pseudo-class {pseudo}")
        if not ok:
            return False
    return True


def _matches(n: Node, steps: list[tuple]) -> bool:
    if not _fits(n, *steps[-1][1:]):
        return False
    if len(steps) == 1:
        return True
    up, direct = n.parent, steps[-1][0] == ">"
    while up is not None and up.tag != "#document":
        if _matches(up, steps[:-1]):
            return True
        if direct:
            return False
        up = up.parent
    return False


def select(doc: Node, selector: str) -> list[Node]:
    """Elements that the selector finds, in document order, each once."""
    alternatives = compile_selector(selector)
    return [n for n in doc.walk() if any(_matches(n, s) for s in alternatives)]


# ---------------------------------------------------------------- signals


#: A parameter's name is glued to its value, so that what is left between separators is a directive or has a colon.
PARAMETER = r":\s+"


def directive_pattern(directive: str) -> str:
    """What finds a directive in a robots value whose parameters are glued; `none` stands for noindex and nofollow. The same
    pattern serves columns and single values.
    """
    names = f"(?:{directive}|none)" if directive in ("noindex", "nofollow") else directive
    return rf"(?i)(?<![^\s,;]){names}(?![^\s,;])"


def has_directive(value: str | None, directive: str) -> bool:
    """Whether a robots value holds the directive; named parameters and their values are none."""
    return re.search(directive_pattern(directive), re.sub(PARAMETER, ":", value or "")) is not None


def header_canonicals(value: str | None, base: str) -> list[str]:
    """Canonical targets of a Link header: the first rel and anchor of each link count, the anchor must be the page."""
    out = []
    for target, rest in re.findall(r"<([^>]*)>((?:[^,\"]|\"(?:[^\"\\]|\\.)*\")*)", value or ""):
        params: dict[str, str] = {}
        for name, quoted, bare in re.findall(r";\s*([\w*-]+)\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"|([^;,\s]*))", rest):
            params.setdefault(name.lower(), quoted or bare)
        if "canonical" not in params.get("rel", "").lower().split():
            continue
        if "anchor" in params and U.joined(U.parse(params["anchor"], base)) != U.joined(U.parse(base)):
            continue
        got = U.resolve_href(target, base)
        if got:
            out.append(got)
    return out


def _strings(value) -> list[str]:
    """All texts within a JSON value, keys aside."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            out.append(v)
        else:
            todo += v if isinstance(v, list) else v.values() if isinstance(v, dict) else ()
    return out


def entities(value, path: str) -> list[tuple[dict, str, bool | None]]:
    """(object, path, context) of the entities of a JSON-LD value, through arrays and @graph, in document order. context: None
    where neither the object nor one around it has any, else whether any of these speaks of schema.org.
    """
    out, todo = [], [(value, path, None)]
    while todo:
        v, at, context = todo.pop()
        if isinstance(v, list):
            todo += [(x, f"{at}[{i}]", context) for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, dict):
            if "@context" in v:
                context = bool(context) or any("schema.org" in s.lower() for s in _strings(v["@context"]))
            if "@type" in v or "@graph" not in v:
                out.append((v, at, context))
            if "@graph" in v:
                todo.append((v["@graph"], f"{at}.@graph", context))
    return out


def _kinds(entity: dict) -> list[str]:
    kind = entity.get("@type")
    return [k.strip() for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str) and k.strip()]


def _empty(v) -> bool:
    return v is None or v == [] or v == {} or (isinstance(v, str) and not v.strip())


def _findings(entity: dict, path: str, context: bool | None) -> list[tuple[str, str, str]]:
    """(severity, message, path) of all that one entity lacks."""
    kinds = _kinds(entity)
    table = [(context is None, NO_CONTEXT, path), (context is False, FOREIGN_CONTEXT, f"{path}.@context"), (not kinds, NO_TYPE, path)]
    table += [(_empty(entity.get(f)), (NO_FIELD[0], NO_FIELD[1].format(kind=k, field=f)), f"{path}.{f}") for k in kinds for f in REQUIRED.get(k, ())]
    return [(severity, text, at) for met, (severity, text), at in table if met]


def structured_data(blocks: list[str]) -> dict:
    """Counts and issues of JSON-LD script blocks, numbered from 1. What a parser says of invalid JSON is its own."""
    invalid, issues = 0, []
    for n, text in enumerate(blocks, 1):
        path = f"script[{n}]"
        try:
            found = entities(json.loads(text), path)
        except ValueError as e:
            invalid += 1
            issues.append((NO_JSON[0], NO_JSON[1].format(n=n, error=e), path))
            continue
        if not found:
            issues.append((NO_ENTITY[0], NO_ENTITY[1].format(n=n), path))
        for entity in found:
            issues += _findings(*entity)
    return {
        "json_ld_count": len(blocks), "json_ld_invalid_count": invalid, "structured_data_error_count": sum(s == "error" for s, _, _ in issues), "structured_data_warning_count": sum(s == "warning" for s, _, _ in issues),
        "structured_data_issues": [{"severity": s, "message": m, "path": p} for s, m, p in issues],
    }


_LANGUAGE = re.compile(r"x-default|[a-z]{2,3}(-([a-z]{2}|[0-9]{3}|[a-z]{4}))*", re.I)


def signals(base: str, markup: str | None, include: str | None = None, exclude: str | None = None) -> dict:
    """Everything a page's markup says, by column name, with lists of its images, anchors, resources and references."""
    doc, doctype = parse(markup)
    active = [n for n in doc.walk() if not n.inert]
    by: dict[str, list[Node]] = {}
    for n in active:
        by.setdefault(n.tag, []).append(n)
    first = lambda tag: (by[tag][0].text() or None) if tag in by else None
    metas = [((m.get("name") or m.get("property") or "").strip().lower(), m.get("content")) for m in by.get("meta", ())]
    meta = lambda name: next((v for k, c in metas if k == name and (v := spaced(c or ""))), None)
    robots = ", ".join(spaced(c) for k, c in metas if k == "robots" and c and c.strip()) or None
    rels = [(n, (n.get("rel") or "").lower().split(), U.resolve_href(n.get("href"), base)) for n in by.get("link", ())]
    linked = lambda *want: [u for _, r, u in rels if u and not set(want).isdisjoint(r)]
    hreflang = [{"hreflang": n.get("hreflang"), "url": u or n.get("href") or "", "valid": bool(u) and bool(_LANGUAGE.fullmatch(n.get("hreflang").strip()))} for n, r, u in rels if "alternate" in r and n.get("hreflang") is not None]
    canonical = linked("canonical")
    title, description, h1, h2 = first("title"), meta("description"), first("h1"), first("h2")
    ids: dict[str, int] = {}
    for n in active:
        if v := (n.get("id") or "").strip():
            ids[v] = ids.get(v, 0) + 1
    images, anchors, resources = [], [], []
    for i, n in enumerate((n for n in by.get("img", ()) if n.get("src") is not None), 1):
        if u := U.resolve_href(n.get("src"), base):
            alt = n.get("alt")
            alt = None if alt is None else alt.strip()
            size = lambda v: int(m.group()) if (m := re.match(r"\s*\d+", v or "")) else None
            images.append({"image_url": u, "alt_text": alt, "alt_len": len(alt or ""), "missing_alt": not alt, "alt_too_long": len(alt or "") > ALT_MAX, "width": size(n.get("width")), "height": size(n.get("height")), "source_position": i})
    for i, n in enumerate((n for n in by.get("a", ()) if n.get("href") is not None), 1):
        if u := U.resolve_href(n.get("href"), base):
            rel = spaced(n.get("rel") or "")
            anchors.append({"target_url": u, "anchor_text": n.text(), "rel": rel, "rel_nofollow": "nofollow" in rel.lower().split(), "source_position": i})
    pictures = [n.get("src") or (n.get("srcset") or "").split(",")[0].split(" ")[0] for n in active if n.tag in ("img", "source")]
    for kind, targets in (("image", pictures), ("css", [n.get("href") for n, r, _ in rels if "stylesheet" in r]), ("javascript", [n.get("src") for n in by.get("script", ())])):
        resources += [{"target_url": u, "link_type": kind} for t in targets if t and (u := U.resolve_href(t, base))]
    for i, r in enumerate(resources, 1):
        r["source_position"] = i
    refs = [("canonical", u) for u in canonical] + [("hreflang", h["url"]) for h in hreflang] + [("pagination", u) for u in linked("next", "prev", "previous")] + [("amp", u) for u in linked("amphtml")]
    for n in by.get("meta", ()):
        if (n.get("http-equiv") or "").lower() == "refresh" and (m := re.search(r"url\s*=\s*['\"]?([^'\";]+)", n.get("content") or "", re.I)) and (u := U.resolve_href(m.group(1), base)):
            refs.append(("metaRefresh", u))
    refs += [("iframe", u) for n in by.get("iframe", ()) if (u := U.resolve_href(n.get("src"), base))]
    scheme = urlsplit(base).scheme
    forms = by.get("form", ())
    insecure = len(forms) if scheme == "http" else sum((U.joined(U.parse(n.get("action") or "", base)) or "").startswith("http://") for n in forms)
    mixed = sum((n.get("src") if n.get("src") is not None else n.get("href") or "").strip().lower().startswith("http://") for n in active if "src" in n.attrs or "href" in n.attrs) if scheme == "https" else 0
    body = by["body"][0] if "body" in by else doc
    text = visible_text(doc, include, exclude) if include or exclude else body.text()
    ld = [("".join(n.texts())) for n in by.get("script", ()) if (n.get("type") or "").split(";")[0].strip().lower() == "application/ld+json"]
    own = U.joined(U.parse(base))
    html = by["html"][0] if "html" in by else doc
    raw = len((markup or "").encode("utf-8", "surrogatepass"))
    return {
        "title": title, "title_count": len(by.get("title", ())), "title_len": len(title or ""), "title_pixel_width": pixel_width(title, TITLE_FONT),
        "meta_description": description, "meta_description_count": sum(k == "description" for k, _ in metas), "meta_description_len": len(description or ""), "meta_description_pixel_width": pixel_width(description, DESCRIPTION_FONT),
        "meta_keywords": meta("keywords"), "meta_robots": robots, "h1": h1, "h1_len": len(h1 or ""), "h1_count": len(by.get("h1", ())), "h2": h2, "h2_len": len(h2 or ""), "h2_count": len(by.get("h2", ())),
        "canonical": canonical[0] if canonical else None, "canonical_count": sum("canonical" in r for _, r, _ in rels), "amphtml_targets": linked("amphtml"), "rel_next_targets": linked("next"), "rel_prev_targets": linked("prev", "previous"),
        "amp_document": "amp" in html.attrs or "⚡" in html.attrs, "html_doctype": doctype, "viewport": any(k == "viewport" for k, _ in metas),
        "word_count": len(text.split()), "text_to_code_ratio": len(text.encode("utf-8", "surrogatepass")) / raw if raw else 0.0,
        "image_count": len(images), "images_missing_alt": sum(i["missing_alt"] for i in images), "images_alt_too_long": sum(i["alt_too_long"] for i in images), "mixed_content_count": mixed, "insecure_form_count": insecure,
        "open_graph_count": sum(k.startswith("og:") for k, _ in metas), "twitter_card_count": sum(k.startswith("twitter:") for k, _ in metas), "deprecated_html_tag_count": sum(n.tag in DEPRECATED for n in active), "duplicate_id_count": sum(c - 1 for c in ids.values()),
        "hreflang_count": len(hreflang), "hreflang_invalid_count": sum(not h["valid"] for h in hreflang), "hreflang_missing_self_reference": bool(hreflang) and all(h["url"] != own for h in hreflang), "hreflang_links": hreflang,
        **structured_data(ld), "images": images, "anchors": anchors, "resources": resources, "references": [{"kind": k, "target_url": u} for k, u in refs],
    }


def visible_text(doc: Node, include: str | None = None, exclude: str | None = None) -> str:
    """Text of the included regions (all without), each node once, without excluded subtrees and what is never shown."""
    wanted = set(map(id, select(doc, include))) if include else None
    banned = set(map(id, select(doc, exclude))) if exclude else set()
    parts: list[str] = []
    stack: list[tuple] = [(doc, wanted is None)]
    while stack:
        n, on = stack.pop()
        if isinstance(n, str):
            parts.append(n) if on else None
        elif n.tag not in UNSEEN and id(n) not in banned:
            on = on or id(n) in wanted if wanted is not None else on
            stack.extend((c, on) for c in reversed(n.children))
    return spaced(" ".join(parts))


# ---------------------------------------------------------------- custom extraction and search


# How much a preview shows.
PREVIEW_VALUES, PREVIEW_CHARS = 100, 2_000


def extract(markup: str, kind: str, pattern: str, attribute: str | None = None, all_matches: bool = True, preview: bool = False) -> list[str]:
    """Values of a custom extractor: css text, css attribute, xpath, or regex (group 1 if there is one). A preview shows the
    first PREVIEW_VALUES, each up to PREVIEW_CHARS characters.
    """
    if kind == "regex":
        found = [(m.group(1) if m.re.groups else m.group()) or "" for m in re.finditer(pattern, markup)]
    elif kind == "xpath":
        from siteloom.functions.xpath import evaluate

        found = evaluate(parse(markup)[0], pattern)
    else:
        nodes = select(parse(markup)[0], pattern)
        found = [n.text() if kind == "css" else spaced(n.get(attribute or "") or "") for n in nodes]
    found = [v for v in map(spaced, found) if v]
    if preview:
        found = [v[:PREVIEW_CHARS] for v in found[:PREVIEW_VALUES]]
    return found if all_matches else found[:1]


def search(markup: str, pattern: str, regex: bool = False, case_sensitive: bool = False, snippets: int = 20, context: int = 48) -> tuple[int, list[str]]:
    """(matches, the first snippets with context) of a custom search; an empty text finds nothing."""
    if not pattern and not regex:
        return 0, []
    found = list(re.finditer(pattern if regex else re.escape(pattern), markup, 0 if case_sensitive else re.I))
    return len(found), [spaced(markup[max(0, m.start() - context) : m.end() + context]) for m in found[:snippets]]
