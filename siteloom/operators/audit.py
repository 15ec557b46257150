"""The 75 named audit views, the 64 rules and the summary, over one projection of flags.

Every operator works within a crawl: `scope` names the columns that tell crawls apart (none for a single crawl).
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import url as U
from siteloom.functions.text import ascii_lower, ascii_text_key, blank, text_key, trimmed
from siteloom.operators import gates, references, sieve
from siteloom.operators.gates import sure
from siteloom.session import checkpointed, of_one_scan
from siteloom.sources.schema import MOST_IDS, once, unrepeated

SCOPE = ["crawl_id"]
# The names of the views.
VIEWS = [
    "All", "Internal", "External", "Status2xx", "Status3xx", "Status4xx", "Status5xx", "NoResponse", "TitleMissing", "TitleDuplicate", "TitleMultiple",
    "TitleTooShort", "TitleTooLong", "TitlePixelTooNarrow", "TitlePixelTooWide", "MetaMissing", "MetaDuplicate", "MetaMultiple", "MetaTooShort",
    "MetaTooLong", "MetaPixelTooNarrow", "MetaPixelTooWide", "H1Missing", "H1Duplicate", "H1TooLong", "H2Missing", "H2Duplicate", "H2TooLong",
    "TitleSameAsH1", "CanonicalMissing", "CanonicalMultiple", "CanonicalUncrawled", "CanonicalToRedirect", "CanonicalToError", "CanonicalNonIndexable",
    "CanonicalChain", "CanonicalLoop", "PaginationNextToError", "PaginationPrevToError", "PaginationNextLoop", "PaginationPrevLoop",
    "PaginationNextNonReciprocal", "PaginationPrevNonReciprocal", "PaginationCanonicalToLinkedPage", "PaginationMultipleTargets", "AmpMultipleTargets",
    "AmpToError", "AmpNonReciprocal", "AmpTargetMissingMarker", "DirectivesNoindex", "ImagesMissingAlt", "ImagesAltTooLong", "SecurityMixedContent",
    "SecurityInsecureForms", "SecurityMissingHsts", "SecurityMissingCsp", "SecurityMissingXFrameOptions", "SecurityMissingContentTypeOptions",
    "MobileMissingViewport", "HreflangInvalid", "HreflangMissingSelfReference", "HreflangMissingReturnLink", "HreflangNonCanonicalTarget",
    "StructuredDataInvalid", "StructuredDataWarning", "HtmlDeprecatedTags", "HtmlMissingDoctype", "HtmlDuplicateIds", "RenderedDomChanged",
    "NearDuplicate", "ExactDuplicate", "ThinContent", "LowTextRatio", "BrokenLinks", "SitemapOrphan",
]


@dataclass(frozen=True)
class Thresholds:
    title_min_chars: int = 30
    title_max_chars: int = 60
    title_min_pixels: int = 200
    title_max_pixels: int = 580
    meta_min_chars: int = 70
    meta_max_chars: int = 160
    meta_min_pixels: int = 400
    meta_max_pixels: int = 920
    h1_max_chars: int = 70
    h2_max_chars: int = 70
    thin_content_words: int = 200
    min_text_ratio_percent: int = 10
    large_image_bytes: int = gates.LARGE_IMAGE_BYTES

    def __post_init__(self):
        bad = [f.name for f in fields(self) if "max" in f.name and getattr(self, f.name) <= 0]
        for what in ("title", "meta"):
            for unit in ("chars", "pixels"):
                if getattr(self, f"{what}_min_{unit}") > getattr(self, f"{what}_max_{unit}"):
                    bad.append(f"{what}_min_{unit}")
        if not 0 <= self.min_text_ratio_percent <= 100:
            bad.append("min_text_ratio_percent")
        if bad:
            raise ValueError(f"invalid thresholds: {', '.join(bad)}")


def _grouped_by() -> dict[str, Column]:
    """By flag the key that makes rows of a crawl duplicates of each other; null where a row takes no part."""
    html = gates.success_html()

    def of(column: str, key) -> Column:
        value = key(F.coalesce(F.col(column), F.lit("")))
        return F.when(html & (value != ""), value)

    keys = {f"dup_{c}": of(c, text_key) for c in ("title", "meta_description", "h1", "h2")}
    keys |= {f"ascii_{c}": of(c, ascii_text_key) for c in ("title", "meta_description", "h1")}
    return keys | {"dup_cluster": F.when(html, F.col("near_duplicate_cluster_id").cast("string"))}


def _repeated(rows: DataFrame, by: list[str], value: str, ahead: bool = False) -> DataFrame:
    """The rows whose `by` is found with two or more values. Least and greatest are all it takes, so exact repeats change
    nothing, no group is held, and a hot key is reduced before the shuffle. With `ahead` the keys are found by a job of their
    own, so that a few are handed round and rows stay where they are.
    """
    groups = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_lo <> _hi").select(*by)
    if ahead:
        groups = checkpointed(groups)
        groups = F.broadcast(groups) if groups.count() <= MOST_IDS else groups
    return rows.join(groups, by, "left_semi")


def duplicates(records: DataFrame, flags: list[str], scope: list[str]) -> DataFrame:
    """(scope, id, flag) of the records that share a key with another record of their crawl, or for dup_hash the response
    hash with a record of another final address. Repeated rows give repeated results.
    """
    parts = []
    keys = {f: k for f, k in _grouped_by().items() if f in flags}
    if keys:
        entries = F.array_compact(F.array(*[F.when(k.isNotNull(), F.struct(F.lit(f).alias("flag"), k.alias("key"))) for f, k in keys.items()]))
        rows = records.where(_SUCCESS).select(*scope, "id", F.explode(entries).alias("_e")).select(*scope, "id", "_e.flag", "_e.key")
        parts.append(_repeated(rows, [*scope, "flag", "key"], "id", ahead=True).select(*scope, "id", "flag"))
    if "dup_hash" in flags:
        rows = records.where(_SUCCESS).where(gates.success_html() & F.col("response_hash").isNotNull()).select(*scope, "id", "response_hash", U.final_key("final_url").alias("_final")).where(F.col("_final").isNotNull())
        parts.append(_repeated(rows, [*scope, "response_hash"], "_final", ahead=True).select(*scope, "id", F.lit("dup_hash").alias("flag")))
    return reduce(DataFrame.unionByName, parts)


HREFLANG_FLAGS = ("hreflang_missing_return", "hreflang_non_canonical")
#: Flags that need more than the row itself.
FLAGS = ("dup_title", "dup_meta_description", "dup_h1", "dup_h2", "dup_cluster", "dup_hash", *references.FLAGS, *HREFLANG_FLAGS)


def marks(records: DataFrame, flags: list[str], scope: list[str]) -> DataFrame:
    """(scope, id, flag), once each, for every one of `flags` that a record has."""
    return _marks(records, flags, scope).distinct()


def masks(records: DataFrame, flags: list[str], scope: list[str]) -> DataFrame:
    """(scope, id, mask), one row per record that has any of `flags`: the bit of a flag is its place in the list."""
    bit = F.create_map(*[x for i, f in enumerate(flags) for x in (F.lit(f), F.lit(1 << i).cast("bigint"))])[F.col("flag")]
    return _marks(records, flags, scope).groupBy(*scope, "id").agg(F.bit_or(bit).alias("mask"))


def _in_mask(flags: list[str], flag: str) -> Column:
    return F.col("mask").bitwiseAND(F.lit(1 << flags.index(flag)).cast("bigint")) != 0


def _marks(records: DataFrame, flags: list[str], scope: list[str]) -> DataFrame:
    """(scope, id, flag), some more than once; what is not asked for is not computed.

    All sources are narrow and are put together by a union, so that records are joined with their flags once or not at all.
    """
    parts = []
    if any(f.startswith(("dup_", "ascii_")) for f in flags):
        parts.append(duplicates(records, [f for f in flags if f.startswith(("dup_", "ascii_"))], scope))
    wide = []
    if asked := [f for f in references.FLAGS if f in flags]:
        parts.append(references.marks(records, scope, asked))
    if set(flags) & set(HREFLANG_FLAGS):
        wide.append(references.hreflang_flags(records, scope))
    for w in wide:
        names = [F.when(F.col(f), F.lit(f)) for f in flags if f in w.columns]
        parts.append(w.select(*scope, "id", F.explode(F.array_compact(F.array(*names))).alias("flag")))
    return reduce(DataFrame.unionByName, parts)


def _over(c: str, n: int = 0) -> Column:
    return sure(F.col(c) > n)


def _many(c: str) -> Column:
    return sure(F.size(c) > 1)


class Lazy(dict):
    """A dict whose values are made by functions when first asked for: building a condition costs many calls to the JVM."""

    def __getitem__(self, name):
        value = super().__getitem__(name)
        if callable(value) and not isinstance(value, tuple):
            value = self[name] = value()
        return value


def predicates(t: Thresholds = Thresholds()) -> dict[str, tuple[Column, str | None]]:
    """Each view's condition on the row, and the flag it needs beside it, if any. html(...) adds the gate of complete
    successful HTML, which all rows with a flag have passed.
    """
    html = lambda c, need=None: (gates.success_html() & sure(c), need)
    plain = lambda c: (sure(c), None)
    col = F.col
    ref = lambda flag: (gates.success_html(), flag)
    ok2xx = gates.success()
    return Lazy({
        "All": lambda: plain(F.lit(True)), "Internal": lambda: plain(col("classification") == "internal"), "External": lambda: plain(col("classification") == "external"),
        "Status2xx": lambda: plain(ok2xx), "Status3xx": lambda: plain(gates.redirect() | sure(F.size("redirect_chain") > 0)),
        "Status4xx": lambda: plain(col("status_code").between(400, 499)), "Status5xx": lambda: plain(col("status_code") >= 500), "NoResponse": lambda: plain(gates.no_response()),
        "TitleMissing": lambda: html(blank("title")), "TitleDuplicate": lambda: ref("dup_title"), "TitleMultiple": lambda: html(_over("title_count", 1)),
        "TitleTooShort": lambda: html(~blank("title") & (col("title_len") < t.title_min_chars)), "TitleTooLong": lambda: html(col("title_len") > t.title_max_chars),
        "TitlePixelTooNarrow": lambda: html(~blank("title") & (col("title_pixel_width") < t.title_min_pixels)), "TitlePixelTooWide": lambda: html(col("title_pixel_width") > t.title_max_pixels),
        "MetaMissing": lambda: html(blank("meta_description")), "MetaDuplicate": lambda: ref("dup_meta_description"), "MetaMultiple": lambda: html(_over("meta_description_count", 1)),
        "MetaTooShort": lambda: html(~blank("meta_description") & (col("meta_description_len") < t.meta_min_chars)), "MetaTooLong": lambda: html(col("meta_description_len") > t.meta_max_chars),
        "MetaPixelTooNarrow": lambda: html(~blank("meta_description") & (col("meta_description_pixel_width") < t.meta_min_pixels)), "MetaPixelTooWide": lambda: html(col("meta_description_pixel_width") > t.meta_max_pixels),
        "H1Missing": lambda: html(blank("h1")), "H1Duplicate": lambda: ref("dup_h1"), "H1TooLong": lambda: html(col("h1_len") > t.h1_max_chars),
        "H2Missing": lambda: html(blank("h2")), "H2Duplicate": lambda: ref("dup_h2"), "H2TooLong": lambda: html(col("h2_len") > t.h2_max_chars),
        "TitleSameAsH1": lambda: html(~blank("title") & (ascii_lower(trimmed("title")) == ascii_lower(trimmed("h1")))),
        "CanonicalMissing": lambda: html(blank("canonical")), "CanonicalMultiple": lambda: html(_over("canonical_count", 1)),
        "CanonicalUncrawled": lambda: ref("canonical_uncrawled"), "CanonicalToRedirect": lambda: ref("canonical_to_redirect"), "CanonicalToError": lambda: ref("canonical_to_error"),
        "CanonicalNonIndexable": lambda: ref("canonical_non_indexable"), "CanonicalChain": lambda: ref("canonical_chain"), "CanonicalLoop": lambda: ref("canonical_loop"),
        "PaginationNextToError": lambda: ref("next_to_error"), "PaginationPrevToError": lambda: ref("prev_to_error"), "PaginationNextLoop": lambda: ref("next_loop"), "PaginationPrevLoop": lambda: ref("prev_loop"),
        "PaginationNextNonReciprocal": lambda: ref("next_non_reciprocal"), "PaginationPrevNonReciprocal": lambda: ref("prev_non_reciprocal"), "PaginationCanonicalToLinkedPage": lambda: ref("pagination_canonical_to_linked_page"),
        "PaginationMultipleTargets": lambda: html(_many("rel_next_targets") | _many("rel_prev_targets")), "AmpMultipleTargets": lambda: html(_many("amphtml_targets")),
        "AmpToError": lambda: ref("amp_to_error"), "AmpNonReciprocal": lambda: ref("amp_non_reciprocal"), "AmpTargetMissingMarker": lambda: ref("amp_target_missing_marker"),
        "DirectivesNoindex": lambda: plain(F.contains(F.lower("indexability_status"), F.lit("noindex"))),
        "ImagesMissingAlt": lambda: html(_over("images_missing_alt")), "ImagesAltTooLong": lambda: html(_over("images_alt_too_long")),
        "SecurityMixedContent": lambda: html(_over("mixed_content_count")), "SecurityInsecureForms": lambda: html(_over("insecure_form_count")),
        "SecurityMissingHsts": lambda: plain(ok2xx & F.startswith("final_url", F.lit("https://")) & ~col("hsts_header")), "SecurityMissingCsp": lambda: html(~col("content_security_policy_header")),
        "SecurityMissingXFrameOptions": lambda: html(~col("x_frame_options_header")), "SecurityMissingContentTypeOptions": lambda: plain(ok2xx & ~col("x_content_type_options_header")),
        "MobileMissingViewport": lambda: html(~col("viewport")), "HreflangInvalid": lambda: html(_over("hreflang_invalid_count")), "HreflangMissingSelfReference": lambda: html(col("hreflang_missing_self_reference")),
        "HreflangMissingReturnLink": lambda: ref("hreflang_missing_return"), "HreflangNonCanonicalTarget": lambda: ref("hreflang_non_canonical"),
        "StructuredDataInvalid": lambda: html(_over("structured_data_error_count") | _over("json_ld_invalid_count")), "StructuredDataWarning": lambda: html(_over("structured_data_warning_count")),
        "HtmlDeprecatedTags": lambda: html(_over("deprecated_html_tag_count")), "HtmlMissingDoctype": lambda: html(~col("html_doctype")), "HtmlDuplicateIds": lambda: html(_over("duplicate_id_count")),
        "RenderedDomChanged": lambda: html(col("rendered_dom_changed")), "NearDuplicate": lambda: ref("dup_cluster"), "ExactDuplicate": lambda: ref("dup_hash"),
        "ThinContent": lambda: html(col("word_count") < t.thin_content_words), "LowTextRatio": lambda: html(col("text_to_code_ratio") * 100 < t.min_text_ratio_percent),
        "BrokenLinks": lambda: plain(gates.broken()), "SitemapOrphan": lambda: plain(col("in_sitemap") & (col("inlink_count") == 0) & (col("classification") == "internal")),
    })


_SUCCESS = "status_code between 200 and 299"
#: What of a view's condition a file reader can test by itself; all views that are not named look at successful pages.
_PUSHED = {
    "All": None, "Internal": "classification = 'internal'", "External": "classification = 'external'", "Status3xx": None, "Status4xx": "status_code between 400 and 499", "Status5xx": "status_code >= 500",
    "NoResponse": "status_code is null and error is not null", "DirectivesNoindex": "indexability_status is not null", "BrokenLinks": None, "SitemapOrphan": "in_sitemap and inlink_count = 0 and classification = 'internal'",
}


def held(records: DataFrame, name: str, thresholds: Thresholds = Thresholds(), scope: list[str] = SCOPE) -> DataFrame:
    """The rows of a named view, their repeats included."""
    condition, flag = predicates(thresholds)[name]
    pushed = _PUSHED.get(name, _SUCCESS)
    rows = (records if pushed is None else records.where(pushed)).where(condition)
    if flag is None:
        return rows
    keys = _grouped_by()
    if flag in keys:
        return _repeated(rows.withColumn("_key", keys[flag]).where("_key is not null"), [*scope, "_key"], "id").drop("_key")
    return sieve.within(rows, checkpointed(_marks(records, [flag], scope).select(*scope, "id")), [*scope, "id"])


def view(records: DataFrame, name: str, thresholds: Thresholds = Thresholds(), scope: list[str] = SCOPE) -> DataFrame:
    """The records of a named view, once each. The condition is met at the scan, before any shuffle."""
    return once(held(records, name, thresholds, scope))


def flagged(records: DataFrame, names: list[str], thresholds: Thresholds = Thresholds(), scope: list[str] = SCOPE, any_of: bool = False) -> DataFrame:
    """`records`, once each, with one boolean column per view name; with `any_of` only those that some view holds.

    Flags of other rows come as one narrow table that is joined once.
    """
    conditions = predicates(thresholds)
    flags = sorted({conditions[n][1] for n in names} - {None})
    rows = records
    if any_of and not flags:
        rows = rows.where(reduce(lambda a, b: a | b, [conditions[n][0] for n in names]))
    rows = once(rows)
    if flags:
        wide = marks(records, flags, scope).groupBy(*scope, "id").agg(*[F.bool_or(F.col("flag") == f).alias(f) for f in flags])
        rows = rows.join(wide, [*scope, "id"], "left")
    rows = rows.withColumns({n: (conditions[n][0] if conditions[n][1] is None else conditions[n][0] & sure(F.col(conditions[n][1]))) for n in names})
    if any_of and flags:
        rows = rows.where(reduce(lambda a, b: a | b, [F.col(n) for n in names]))
    return rows.drop(*flags)


#: Labels that are tested in one pass.
AT_ONCE = 6


def hits(records: DataFrame, wanted: dict[str, tuple[Column, str | None]], scope: list[str], columns: tuple = (), values: dict[str, Column] | None = None) -> DataFrame:
    """(scope, id, columns, label, value): one row per record and label of `wanted` - (condition, flag) by label - it meets,
    with the label's text from `values`. Repeated rows count once.

    Over a table's own rows a few labels are tested at a time, in compiled code of a size that the JVM compiles further, and
    nothing is shuffled. Else labels without a flag are entries of one array; only rows with any are shuffled, narrow. Labels
    with a flag meet the marks by one join.
    """
    values = values or {}
    none = F.lit(None).cast("string")
    parts = []
    single = unrepeated(records, many=lambda rows: None) if of_one_scan(records) else None
    if single is not None:
        def met(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
            entries = [F.when(c, F.struct(F.lit(label).alias("label"), values.get(label, none).alias("value"))) for label, c in conditions.items()]
            got = rows.select(*scope, "id", *columns, F.array(*entries).alias("_hits"))
            return got.select("*", F.explode("_hits").alias("_h")).where("_h is not null").select(*scope, "id", *got.columns[len(scope) + 1 : -1], "_h.label", "_h.value")

        own = [(label, c) for label, (c, flag) in wanted.items() if flag is None]
        parts += [met(single, dict(own[i : i + AT_ONCE])) for i in range(0, len(own), AT_ONCE)]
        of = {label: flag for label, (_, flag) in wanted.items() if flag is not None}
        if of:
            flags = list(dict.fromkeys(of.values()))
            marked = single.join(masks(records, flags, scope), [*scope, "id"])
            parts.append(met(marked, {label: _in_mask(flags, flag) for label, flag in of.items()}))
        return reduce(DataFrame.unionByName, parts)
    own = {label: c for label, (c, flag) in wanted.items() if flag is None}
    if own:
        found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(label).alias("label"), values.get(label, none).alias("value"))) for label, c in own.items()]))
        rows = records.select(*scope, "id", *columns, found.alias("_hits")).where(F.size("_hits") > 0).distinct()
        parts.append(rows.select("*", F.explode("_hits").alias("_h")).select(*scope, "id", *rows.columns[len(scope) + 1 : -1], "_h.label", "_h.value"))
    flags = {flag: label for label, (_, flag) in wanted.items() if flag is not None}
    if flags:  # only rows that have passed a label's gate have its flag
        met = records.join(marks(records, list(flags), scope), [*scope, "id"])
        label = F.create_map(*[F.lit(x) for kv in flags.items() for x in kv])[F.col("flag")]
        value = none
        if values:
            value = reduce(lambda a, kv: a.when(F.col("flag") == kv[0], values.get(kv[1], none)), flags.items(), F.when(F.lit(False), none))
        parts.append(met.select(*scope, "id", *columns, label.alias("label"), value.alias("value")).distinct())
    return reduce(DataFrame.unionByName, parts)


# Fixed values. Rule: (view, severity, message); braces hold a column, a threshold or one of `_derived`.
RULES = {
    "response.client_error": ("Status4xx", "error", "Client error response: {status_code}"),
    "response.server_error": ("Status5xx", "error", "Server error response: {status_code}"),
    "response.redirect_error": ("_redirect_error", "error", "{error}"),
    "response.no_response": ("NoResponse", "error", "{error}"),
    "directives.noindex": ("DirectivesNoindex", "info", "URL is marked noindex"),
    "security.mixed_content": ("SecurityMixedContent", "warning", "{mixed_content_count} mixed content resource(s)"),
    "security.insecure_forms": ("SecurityInsecureForms", "warning", "{insecure_form_count} insecure form(s)"),
    "security.missing_hsts": ("SecurityMissingHsts", "warning", "HTTPS response is missing Strict-Transport-Security"),
    "security.missing_csp": ("SecurityMissingCsp", "info", "HTML response is missing Content-Security-Policy"),
    "security.missing_x_frame_options": ("SecurityMissingXFrameOptions", "info", "HTML response is missing X-Frame-Options"),
    "security.missing_x_content_type_options": ("SecurityMissingContentTypeOptions", "info", "Response is missing X-Content-Type-Options"),
    "sitemap.orphan": ("SitemapOrphan", "warning", "URL is present in the sitemap but has no discovered in-links"),
    "title.multiple": ("TitleMultiple", "warning", "Page contains {title_count} title elements"),
    "title.missing": ("TitleMissing", "warning", "Missing page title"),
    "title.duplicate": ("TitleDuplicate", "warning", "Duplicate page title"),
    "title.too_short": ("TitleTooShort", "info", "Page title is shorter than {title_min_chars} characters"),
    "title.too_long": ("TitleTooLong", "warning", "Page title is longer than {title_max_chars} characters"),
    "title.same_as_h1": ("TitleSameAsH1", "info", "Page title is the same as H1"),
    "meta_description.multiple": ("MetaMultiple", "warning", "Page contains {meta_description_count} meta description elements"),
    "meta_description.missing": ("MetaMissing", "warning", "Missing meta description"),
    "meta_description.duplicate": ("MetaDuplicate", "warning", "Duplicate meta description"),
    "meta_description.too_short": ("MetaTooShort", "info", "Meta description is shorter than {meta_min_chars} characters"),
    "meta_description.too_long": ("MetaTooLong", "warning", "Meta description is longer than {meta_max_chars} characters"),
    "h1.missing": ("H1Missing", "warning", "Missing H1"),
    "h1.duplicate": ("H1Duplicate", "warning", "Duplicate H1"),
    "h1.too_long": ("H1TooLong", "info", "H1 is longer than {h1_max_chars} characters"),
    "h2.missing": ("H2Missing", "info", "Missing H2"),
    "h2.duplicate": ("H2Duplicate", "info", "Duplicate H2"),
    "h2.too_long": ("H2TooLong", "info", "H2 is longer than {h2_max_chars} characters"),
    "canonical.missing": ("CanonicalMissing", "info", "Missing canonical URL"),
    "canonical.multiple": ("CanonicalMultiple", "warning", "Multiple canonical link elements"),
    "canonical.uncrawled": ("CanonicalUncrawled", "info", "Canonical target has not been crawled: {canonical}"),
    "canonical.to_redirect": ("CanonicalToRedirect", "warning", "Canonical target redirects: {canonical}"),
    "canonical.to_error": ("CanonicalToError", "error", "Canonical target has a response or fetch error: {canonical}"),
    "canonical.non_indexable": ("CanonicalNonIndexable", "warning", "Canonical target is non-indexable or blocked by robots.txt: {canonical}"),
    "canonical.chain": ("CanonicalChain", "warning", "Canonical target declares a further canonical: {canonical}"),
    "canonical.loop": ("CanonicalLoop", "error", "Canonical path enters a loop: {canonical}"),
    "pagination.canonical_to_linked_page": ("PaginationCanonicalToLinkedPage", "warning", "Captured canonical resolves to a different observed HTML page linked by a captured next or previous declaration: {canonical}"),
    "pagination.next_to_error": ("PaginationNextToError", "error", "Pagination next target has a response or fetch error: {next_context}"),
    "pagination.prev_to_error": ("PaginationPrevToError", "error", "Pagination prev target has a response or fetch error: {prev_context}"),
    "pagination.next_loop": ("PaginationNextLoop", "error", "Next pagination path enters a loop: {next_context}"),
    "pagination.prev_loop": ("PaginationPrevLoop", "error", "Previous pagination path enters a loop: {prev_context}"),
    "pagination.next_non_reciprocal": ("PaginationNextNonReciprocal", "warning", "Captured next target does not link back through its captured previous relation: {next_context}"),
    "pagination.prev_non_reciprocal": ("PaginationPrevNonReciprocal", "warning", "Captured previous target does not link back through its captured next relation: {prev_context}"),
    "pagination.multiple_targets": ("PaginationMultipleTargets", "info", "Multiple captured pagination declarations: {next_count} next, {prev_count} previous"),
    "amp.to_error": ("AmpToError", "error", "AMP target has a response or fetch error: {amp_context}"),
    "amp.non_reciprocal": ("AmpNonReciprocal", "warning", "Observed AMP target does not canonically return to the declaring page: {amp_context}"),
    "amp.target_missing_marker": ("AmpTargetMissingMarker", "warning", "Observed complete HTML target lacks an amp/⚡ attribute on its original HTML element; this is necessary marker evidence, not full AMP validation: {amp_context}"),
    "amp.multiple_targets": ("AmpMultipleTargets", "info", "Multiple captured AMP declarations: {amp_count} targets"),
    "images.missing_alt": ("ImagesMissingAlt", "warning", "{images_missing_alt} image(s) missing alt text"),
    "images.alt_too_long": ("ImagesAltTooLong", "info", "{images_alt_too_long} image alt attribute(s) longer than 125 characters"),
    "content.thin": ("ThinContent", "info", "Page has {word_count} words, below the {thin_content_words}-word thin-content threshold"),
    "content.low_text_ratio": ("LowTextRatio", "info", "Visible text is {text_percent}% of the HTML, below the {min_text_ratio_percent}% minimum"),
    "mobile.missing_viewport": ("MobileMissingViewport", "warning", "HTML page is missing a viewport meta tag"),
    "hreflang.invalid": ("HreflangInvalid", "warning", "Page has {hreflang_invalid_count} invalid hreflang value(s)"),
    "hreflang.missing_self_reference": ("HreflangMissingSelfReference", "warning", "Page has hreflang alternates but no self-reference"),
    "structured_data.invalid_json_ld": ("StructuredDataInvalid", "error", "Page has {data_errors} structured data error(s)"),
    "structured_data.warning": ("StructuredDataWarning", "warning", "Page has {structured_data_warning_count} structured data warning(s)"),
    "html.missing_doctype": ("HtmlMissingDoctype", "warning", "No HTML doctype was observed in the original HTTP HTML"),
    "html.deprecated_tags": ("HtmlDeprecatedTags", "warning", "{deprecated_html_tag_count} deprecated HTML tag instance(s)"),
    "html.duplicate_ids": ("HtmlDuplicateIds", "warning", "{duplicate_id_count} duplicate HTML id instance(s)"),
    "rendering.dom_changed": ("RenderedDomChanged", "info", "Rendered DOM changed the crawlable content by {rendered_word_count_delta} words and {rendered_link_count_delta} links"),
    "content.near_duplicate": ("NearDuplicate", "info", "Near-duplicate content cluster {near_duplicate_cluster_id}"),
    "content.exact_duplicate": ("ExactDuplicate", "info", "Identical downloaded response body (hash {response_hash}) at multiple final URLs"),
}


def _derived() -> dict[str, Column]:
    """What messages say beside plain columns: counts of declared targets, the only one's address, percentages."""

    def context(targets: str, single: str) -> Column:
        several = F.concat(F.size(targets).cast("string"), F.lit(" captured targets; inspect the selected page's target list"))
        first = F.coalesce(F.get(targets, F.lit(0)), F.lit(""))
        return F.when(F.size(targets) > 1, several).when(F.col(targets).isNotNull(), first).otherwise(F.coalesce(F.col(single), F.lit("")))

    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("string")).otherwise("unknown")
    return {
        "next_context": context("rel_next_targets", "rel_next"), "prev_context": context("rel_prev_targets", "rel_prev"), "amp_context": context("amphtml_targets", "amphtml"),
        "next_count": size("rel_next_targets"), "prev_count": size("rel_prev_targets"), "amp_count": size("amphtml_targets"),
        "data_errors": F.greatest("structured_data_error_count", "json_ld_invalid_count").cast("string"), "text_percent": F.call_function("format_number", F.col("text_to_code_ratio") * 100, F.lit("0.0")),
    }


def message(text: str, derived: dict[str, Column], t: Thresholds) -> Column:
    """A text with its braces filled: thresholds and `derived` by name, else the column (null: empty)."""
    parts = []
    for i, piece in enumerate(text.replace("}", "{").split("{")):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif hasattr(t, piece):
            parts.append(F.lit(str(getattr(t, piece))))
        else:
            parts.append(derived[piece] if piece in derived else F.coalesce(F.col(piece).cast("string"), F.lit("")))
    return F.concat(*parts)


def rule_conditions(t: Thresholds = Thresholds()) -> dict[str, tuple[Column, str | None]]:
    """Each rule's condition and flag. A redirect with an error has no view of its own; too short and too long do not follow
    a missing text.
    """
    p = predicates(t)
    p["_redirect_error"] = (gates.redirect() & F.col("error").isNotNull(), None)
    out = {}
    for rule, (name, _, _) in RULES.items():
        condition, flag = p[name]
        family = rule.split(".")[0]
        missing = {"title": "title", "meta_description": "meta_description", "h1": "h1", "h2": "h2"}.get(family)
        if missing and not rule.endswith((".missing", ".multiple")):
            condition = condition & ~blank(missing)
        out[rule] = (condition, flag)
    return out


def issues(records: DataFrame, thresholds: Thresholds = Thresholds(), scope: list[str] = SCOPE) -> DataFrame:
    """(scope, id, rule, severity, view, url, message): one row per record and rule that fires.

    All rules of the row itself are met in one scan, all others come from one union of flags (see `hits`).
    """
    derived = _derived()
    found = hits(records, rule_conditions(thresholds), scope, (F.col("final_url").alias("url"),), {r: message(m, derived, thresholds) for r, (_, _, m) in RULES.items()})
    of = lambda k: F.create_map(*[F.lit(x) for r, v in RULES.items() for x in (r, k(v))])[F.col("label")]
    named = of(lambda v: "BrokenLinks" if v[0].startswith(("Status", "_")) else v[0])
    return found.select(*scope, "id", "url", F.col("label").alias("rule"), of(lambda v: v[1]).alias("severity"), named.alias("view"), F.col("value").alias("message"))


#: Counter: view.
COUNTERS = {
    "total": "All", "internal": "Internal", "external": "External", "success": "Status2xx", "redirects": "Status3xx", "client_errors": "Status4xx", "server_errors": "Status5xx", "no_response": "NoResponse", "broken": "BrokenLinks",
    "near_duplicates": "NearDuplicate", "exact_duplicates": "ExactDuplicate", "title_missing": "TitleMissing", "title_duplicate": "TitleDuplicate", "title_multiple": "TitleMultiple",
    "meta_missing": "MetaMissing", "meta_duplicate": "MetaDuplicate", "meta_multiple": "MetaMultiple", "h1_missing": "H1Missing", "h1_duplicate": "H1Duplicate", "h2_missing": "H2Missing", "h2_duplicate": "H2Duplicate",
    "canonical_missing": "CanonicalMissing", "canonical_multiple": "CanonicalMultiple", "canonical_uncrawled": "CanonicalUncrawled", "canonical_to_redirect": "CanonicalToRedirect", "canonical_to_error": "CanonicalToError",
    "canonical_non_indexable": "CanonicalNonIndexable", "canonical_chain": "CanonicalChain", "canonical_loop": "CanonicalLoop", "pagination_next_to_error": "PaginationNextToError", "pagination_prev_to_error": "PaginationPrevToError",
    "pagination_next_loop": "PaginationNextLoop", "pagination_prev_loop": "PaginationPrevLoop", "pagination_next_non_reciprocal": "PaginationNextNonReciprocal", "pagination_prev_non_reciprocal": "PaginationPrevNonReciprocal",
    "pagination_canonical_to_linked_page": "PaginationCanonicalToLinkedPage", "pagination_multiple_targets": "PaginationMultipleTargets", "amp_multiple_targets": "AmpMultipleTargets", "amp_to_error": "AmpToError",
    "amp_non_reciprocal": "AmpNonReciprocal", "amp_target_missing_marker": "AmpTargetMissingMarker", "noindex": "DirectivesNoindex", "images_missing_alt": "ImagesMissingAlt", "images_alt_too_long": "ImagesAltTooLong",
    "mixed_content": "SecurityMixedContent", "insecure_forms": "SecurityInsecureForms", "hreflang_invalid": "HreflangInvalid", "structured_data_invalid": "StructuredDataInvalid", "structured_data_warnings": "StructuredDataWarning",
    "deprecated_html_tags": "HtmlDeprecatedTags", "missing_html_doctype": "HtmlMissingDoctype", "duplicate_ids": "HtmlDuplicateIds", "rendered_dom_changed": "RenderedDomChanged", "missing_viewport": "MobileMissingViewport",
    "missing_hsts": "SecurityMissingHsts", "sitemap_orphans": "SitemapOrphan",
}

REFERENCE_COUNTERS = tuple(c for c in COUNTERS if c.startswith(("canonical_", "pagination_", "amp_")) and c not in ("canonical_missing", "canonical_multiple", "pagination_multiple_targets", "amp_multiple_targets"))


def summary(records: DataFrame, counters: list[str] | None = None, thresholds: Thresholds = Thresholds(), scope: list[str] = SCOPE) -> DataFrame:
    """One row per crawl: how many records each counter's view holds, and how many are indexable or not.

    Rows of a table without repeats are counted where they are. Else the conditions of a row are bits of one or two numbers, so
    what is shuffled to drop repeats is the id and these. Counters
    that need other rows are counted from their flags, without a join with the records.
    """
    names = list(COUNTERS) if counters is None else counters
    p = predicates(thresholds)
    own = {c: p[COUNTERS[c]][0] for c in names if p[COUNTERS[c]][1] is None}
    own |= {"indexable": sure(F.col("indexability") == "Indexable"), "non_indexable": sure(F.col("indexability") == "Non-indexable")}
    place = {c: divmod(i, 60) for i, c in enumerate(own)}
    words = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(own[c], F.lit(1 << at)).otherwise(F.lit(0)).cast("bigint") for c, (w, at) in place.items() if w == n]).alias(f"_w{n}") for n in range(-(-len(own) // 60))]
    single = unrepeated(records, many=lambda rows: None) if of_one_scan(records) else None
    rows = records.select(*scope, "id", *words).distinct()
    if single is not None:
        parts = [single.groupBy(*scope).agg(*[F.count_if(own[c]).alias(c) for c in place])]
    else:
        parts = [rows.groupBy(*scope).agg(*[F.count_if(F.col(f"_w{w}").bitwiseAND(F.lit(1 << at).cast("bigint")) != 0).alias(c) for c, (w, at) in place.items()])]
    flags = {p[COUNTERS[c]][1]: c for c in names if c not in own}
    if flags:
        parts.append(masks(records, list(flags), scope).groupBy(*scope).agg(*[F.count_if(_in_mask(list(flags), f)).alias(c) for f, c in flags.items()]))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return both.groupBy(*scope).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*names, "indexable", "non_indexable")])


def progress_summary(records: DataFrame, thresholds: Thresholds = Thresholds(), scope: list[str] = SCOPE) -> DataFrame:
    """The summary without the counters that join references or compare whole responses."""
    return summary(records, [c for c in COUNTERS if c not in REFERENCE_COUNTERS and c != "exact_duplicates"], thresholds, scope)
