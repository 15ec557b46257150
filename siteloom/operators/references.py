"""Where canonical, pagination, AMP and hreflang references of a crawl lead, as flags per record.

All joins are equi-joins on aliases within one crawl. An alias that half of all records point to meets the index as one
row, so the hot side is never multiplied; AQE splits its skewed partition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siteloom.functions import url as U
from siteloom.functions.text import blank, trimmed
from siteloom.operators import gates, sieve
from siteloom.session import checkpointed, of_one_scan
from siteloom.sources.schema import unrepeated

FLAGS = (
    "canonical_uncrawled", "canonical_to_redirect", "canonical_to_error", "canonical_non_indexable", "canonical_chain", "canonical_loop",
    "next_to_error", "prev_to_error", "amp_to_error", "next_loop", "prev_loop", "next_non_reciprocal", "prev_non_reciprocal",
    "amp_non_reciprocal", "pagination_canonical_to_linked_page", "amp_target_missing_marker",
)

CANONICAL, RELATIONS = FLAGS[:6], FLAGS[6:]


def _hops() -> Column:
    return F.filter("redirect_chain", lambda h: h["status_code"].between(300, 399))


#: What is asked of a target, as bits of one number. Counts of declared targets are none, one or more.
ERROR, ELIGIBLE, UNMARKED, NEXT_ONE, NEXT_MORE, PREV_ONE, PREV_MORE, BROKEN, NON_INDEXABLE, OBSERVED, REDIRECT, FETCHED, NEAR, OWN = (1 << i for i in range(14))


def _canonical_is_own() -> Column:
    return gates.sure(F.col("canonical") == F.col("url"))


def has(bit: int) -> Column:
    return gates.sure(F.col("facts").bitwiseAND(F.lit(bit)) != 0)


def attributes(records: DataFrame, scope: list[str], repeats: bool = False) -> DataFrame:
    """The few columns that reference questions ask of a record, repeats once. With `repeats` they may stay in, where finding
    them takes a job of its own.
    """
    target_error = gates.no_response() | gates.sure(F.col("status_code").between(400, 599)) | (gates.redirect() & F.col("error").isNotNull())
    fetched = F.col("status_code").isNotNull() | F.col("error").isNotNull() | gates.robots_blocked()
    non_indexable = gates.robots_blocked() | (gates.sure(F.col("indexability") == "Non-indexable") & ~gates.broken() & ~gates.redirect())
    observed = F.col("status_code").isNotNull() | gates.no_response()
    none = F.array().cast("array<string>")
    declared = {"next": "rel_next", "prev": "rel_prev", "amp": "amphtml"}
    of = {k: F.coalesce(f"{c}_targets", F.when(F.col(c).isNotNull(), F.array(c)).otherwise(none)) for k, c in declared.items()}
    listed = {k: F.col(f"{c}_targets").isNotNull() for k, c in declared.items()}
    count = {k: F.when(listed[k], F.size(f"{c}_targets")).otherwise(F.when(F.col(c).isNotNull(), 1).otherwise(0)) for k, c in declared.items()}
    first = {k: F.when(listed[k], F.get(f"{c}_targets", F.lit(0))).otherwise(F.col(c)) for k, c in declared.items()}
    bits = {ERROR: target_error, ELIGIBLE: gates.success_html(), UNMARKED: gates.sure(~F.col("amp_document")), BROKEN: gates.broken(), NON_INDEXABLE: non_indexable, OBSERVED: observed, FETCHED: fetched, OWN: _canonical_is_own()}
    bits |= {one: count[k] == 1 for k, one in (("next", NEXT_ONE), ("prev", PREV_ONE))} | {more: count[k] > 1 for k, more in (("next", NEXT_MORE), ("prev", PREV_MORE))}
    facts = reduce(lambda x, y: x.bitwiseOR(y), [F.when(on, F.lit(bit)).otherwise(F.lit(0)) for bit, on in bits.items()])
    # A scope that is a literal would be left out of a grouping but not of a join, which would then have to shuffle once more.
    rows = records.select(
        *[F.when(F.col("id").isNotNull(), F.col(c)).alias(c) for c in scope], "id", "url", "final_url", "canonical", F.when(F.size("redirect_chain") > 0, F.transform(_hops(), lambda h: h["url"])).otherwise(none).alias("hops"), gates.redirect().alias("is_3xx"), (F.col("classification") == "internal").alias("internal"),
        gates.success_html().alias("eligible"), fetched.alias("fetched"), non_indexable.alias("non_indexable"), observed.alias("observed"), gates.sure(F.col("error") == "Redirect limit exceeded").alias("limit"),
        facts.alias("facts"), *[c.alias(k) for k, c in of.items()], *[c.alias(f"{k}_count") for k, c in count.items()], *[c.alias(f"{k}_first") for k, c in first.items()],
    )
    if of_one_scan(records):
        return rows if repeats else unrepeated(rows)
    return checkpointed(rows.distinct())


def _alone() -> Column:
    """Whether a record has one address, which has no other alias."""
    return U.is_alone("url") & F.col("url").eqNullSafe(F.col("final_url"))


def _simple(kinds: list[str]) -> Column:
    """Whether a record has one name, and of each kind one target at most, with one name as well."""
    ok = F.lit(True)
    for k in kinds:
        ok = ok & ((F.col(k).isNull() | ~_absolute() | U.is_alone(k)) if k == "canonical" else (F.col(f"{k}_count") <= 0) | ((F.col(f"{k}_count") == 1) & U.is_alone(f"{k}_first")))
    return _alone() & (F.size("hops") <= 0) & (~F.col("eligible") | ok)


def sorted_out(attrs: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame | None, bool]:
    """`_simple` records and, if there are any, the others, kept. Most crawls have few others or none, so all that takes lists
    of names is spared the simple ones. And whether few of many records, all simple, ask for anything.
    """
    asks = F.lit("canonical" in kinds) | (F.col("eligible") & reduce(lambda x, y: x | y, [F.col(f"{k}_count") > 0 for k in kinds if k != "canonical"], F.lit(False)))
    n, asked, total = attrs.agg(F.count_if(~_simple(kinds)), F.count_if(asks), F.count(F.lit(1))).first()
    few = not n and total > sieve.WORTH and asked < min(sieve.MOST_KEYS, total / 4)
    return (attrs.where(_simple(kinds)), checkpointed(attrs.where(~_simple(kinds))), few) if n else (attrs, None, few)


def alias_index(simple: DataFrame, others: DataFrame | None, scope: list[str], fetched: bool = False, among: DataFrame | None = None) -> DataFrame:
    """Per alias the best observed (or, as asked, `fetched`) candidate record, as (_id, _known): request address before redirect
    hop before final address, then the lowest id. A final address that is among the record's request addresses stands behind
    them and is left out. The hash of the alias comes first, as numbers are sorted and compared at less cost than addresses;
    numbers alone are aggregated, so that nothing is sorted for it. With `among` only aliases found there are wanted.
    """
    fields = lambda seen, r: ["fetched", seen.alias("seen"), F.col("facts").bitwiseOR(F.when(r, F.lit(REDIRECT)).otherwise(F.lit(0))).alias("facts")]
    named, ranks = simple.select(*scope, "id", F.col("url").alias("alias"), F.lit(0).alias("p"), *fields(F.col("observed"), F.col("is_3xx"))), [0]
    if others is not None:
        ranks, kept = [0, 1, 2], [*scope, "id", "fetched", "observed", "limit", "facts"]
        entry = lambda p, r: lambda u: F.struct(u.alias("alias"), F.lit(p).alias("p"), r.alias("r"))
        own = F.concat(F.transform("url_names", entry(0, F.col("is_3xx") | (F.size("hops") > 0))), F.transform(F.array_except("final_names", "url_names"), entry(2, F.col("is_3xx"))))
        several = U.with_names(others, url_names="url", final_names="final_url").select(*kept, F.explode(own).alias("_n")).select(*kept, "_n.*")
        hops = U.with_aliases(others.where(F.size("hops") > 0).select(*kept, F.explode("hops").alias("_u")), ["_u"]).select(*kept, "alias", F.lit(1).alias("p"), F.lit(True).alias("r"))
        named = named.unionByName(several.unionByName(hops).select(*scope, "id", "alias", "p", *fields(F.col("observed") & ~((F.col("p") == 2) & F.col("limit")), F.col("r"))))
    named = named.where("fetched" if fetched else "seen")
    if among is not None:
        named = sieve.sieved(named, among, ["alias"])

    # The first rank's lowest id, and what is known of it.
    at = [F.when(F.col("p") == p, F.col("id")) for p in ranks] if others is not None else [F.col("id")]
    best = [F.coalesce(*[F.min(x) for x in at]).alias("_id"), F.coalesce(*[F.min_by("facts", x) for x in at]).alias("_known"), F.min("p").alias("_p")]
    return named.groupBy(F.hash("alias").alias("_h"), *scope, "alias").agg(*(best if others is not None else best[:2]))


def _absolute() -> Column:
    return F.when(U.is_alone("canonical"), True).otherwise(F.rlike(trimmed(F.coalesce("canonical", F.lit(""))), F.lit("(?i)^https?://")))


def self_canonicals(attrs: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, id, flag) of eligible records whose canonical is one of their own aliases: they are their own target."""
    alone = _alone() & U.is_alone("canonical")
    names = U.with_names(attrs.where(F.col("eligible") & _absolute() & ~alone), url_names="url", final_names="final_url", canonical_names="canonical")
    found = lambda hop: F.array(F.when(F.col("is_3xx") | hop, F.lit("canonical_to_redirect")), F.when(F.col("non_indexable"), F.lit("canonical_non_indexable")))
    one = attrs.where(F.col("eligible") & alone & (F.col("canonical") == F.col("url"))).select(*scope, "id", found(F.array_contains("hops", F.col("canonical"))).alias("_f"))
    rest = names.where(F.arrays_overlap(F.concat("url_names", "final_names"), "canonical_names")).select(*scope, "id", found(F.arrays_overlap("canonical_names", "hops")).alias("_f"))
    return one.unionByName(rest).select(*scope, "id", F.explode("_f").alias("flag")).where("flag is not null")


def _declared(kind: str):
    return lambda text, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), F.size(kind).alias("n"), text.alias("text"), F.lit(0).alias("near"))


def _requests(simple: DataFrame, scope: list[str], kinds: list[str], near: Column, away: bool) -> DataFrame:
    """What eligible `_simple` records ask for, in one pass."""
    rows, asked = simple.where("eligible"), []
    if away:
        rows = rows.where(U.is_alone("canonical") & (F.col("canonical") != F.col("url")))
    for k in kinds:
        text, own = (F.col(k), F.lit(False)) if k == "canonical" else (F.col(f"{k}_first"), F.col(f"{k}_first") == F.col("url"))
        met = U.is_alone(k) & (text != F.col("url")) if k == "canonical" else F.col(f"{k}_count") > 0
        asked.append((met, F.struct(F.lit(k).alias("kind"), (near if k == "canonical" else F.lit(0)).alias("near"), F.when(own, F.col("facts")).alias("_facts"), own.alias("_self"), text.alias("alias"))))
    if len(asked) == 1:
        rows = rows.where(asked[0][0]).select(*scope, "id", asked[0][1].alias("_e"))
    else:
        rows = rows.select(*scope, "id", F.explode(F.array(*[F.when(*a) for a in asked])).alias("_e")).where("_e is not null")
    return rows.select(*scope, "id", "_e.kind", F.lit(0).alias("at"), F.lit(1).alias("n"), "_e.near", "_e._facts", "_e._self", F.lit(1).alias("_m"), "_e.alias")


def targets_of(attrs: DataFrame, scope: list[str], kinds: list[str], away: bool = False, once: bool = False, parts: tuple | None = None) -> tuple[DataFrame, bool]:
    """(scope, id, kind, at, n, target, facts): the record that each canonical and each declared next, prev or amp target of
    an eligible record resolves to - null: unknown, for canonicals not fetched, for declared ones not observed - and what is
    known of it. n is how many the record declares. And whether any record may declare several.

    A target among the source's own aliases is the source; a canonical among them is left out (`self_canonicals`). With
    `away` only records whose canonical leads away are asked. Declared targets meet the index in one join and canonicals in
    another; the result is kept. If each kind is read `once` and there are simple records only, each has its own join and
    nothing is kept. An index for both at once would be code too long for the JVM to compile.
    """
    near = F.when(F.col("internal") & gates.sure(U.host(F.lower(trimmed("canonical"))) == U.host(F.lower("final_url"))), F.lit(NEAR)).otherwise(F.lit(0))
    simple, others, few = parts or sorted_out(attrs, kinds)
    apart = once and others is None
    none = F.array().cast("array<struct<kind:string,at:int,n:int,text:string,near:int>>")

    def listed(ks: list[str]) -> DataFrame:
        """What the others ask for."""
        one = F.when(_absolute(), F.array(F.struct(F.lit("canonical").alias("kind"), F.lit(0).alias("at"), F.lit(1).alias("n"), F.col("canonical").alias("text"), near.alias("near"))))
        lists = [F.coalesce(one, none) if k == "canonical" else F.coalesce(F.when(F.size(k) > 0, F.transform(k, _declared(k))), none) for k in ks]
        names = dict(url_names="url", final_names="final_url") | ({"canonical_names": "canonical"} if away else {})
        rest = U.with_names(others.where(F.col("eligible") & (_absolute() if away else F.lit(True))), **names).withColumn("_mine", F.concat("url_names", "final_names"))
        if away:
            rest = rest.where(~F.arrays_overlap("_mine", "canonical_names"))
        more = rest.select(*scope, "id", "_mine", "hops", F.col("facts").alias("_facts"), F.explode(F.concat(*lists)).alias("_e")).select(*scope, "id", "_mine", "hops", "_facts", "_e.*")
        more = U.with_names(more, _names="text")
        itself = F.arrays_overlap("_mine", "_names") | ((F.col("kind") != "canonical") & F.arrays_overlap("hops", "_names"))
        more = more.select(*scope, "id", "kind", "at", "n", "near", "_facts", F.coalesce(itself, F.lit(False)).alias("_self"), F.size("_names").alias("_m"), F.explode_outer("_names").alias("alias"))
        return more.where(~((F.col("kind") == "canonical") & F.col("_self")))

    def met(ks: list[str]) -> DataFrame:
        rows = _requests(simple, scope, ks, near, away)
        rows = rows if others is None else rows.unionByName(listed(ks))
        return rows.withColumn("_h", F.hash("alias")).join(alias_index(simple, others, scope, ks == ["canonical"], rows if few else None), ["_h", *scope, "alias"], "left")

    groups = [[k] for k in kinds] if apart else [g for g in ([k for k in kinds if k == "canonical"], [k for k in kinds if k != "canonical"]) if g]
    met_all = reduce(DataFrame.unionByName, map(met, groups))
    # What a record knows of itself also holds where it is its own target.
    target = lambda i: F.when(F.col("_self"), F.col("id")).otherwise(i).alias("target")
    facts = lambda f: F.when(F.col("_self"), F.col("_facts")).otherwise(F.coalesce(f, F.lit(0))).bitwiseOR(F.col("near")).alias("facts")
    best = [*scope, "id", "kind", "at", "n", target(F.col("_id")), facts(F.col("_known"))]
    if others is None:
        return met_all.select(*best) if apart else checkpointed(met_all.select(*best)), False
    several = F.struct("near", "_facts", "_self", F.when(F.col("_id").isNotNull(), F.struct("_p", "_id", "_known")).alias("best"))
    kept = checkpointed(met_all.select(*best, F.when(F.col("_m") > 1, several).alias("_all")))
    more = kept.where("_all is not null").groupBy(*scope, "id", "kind", "at", "n", F.col("_all.near").alias("near"), F.col("_all._facts").alias("_facts"), F.col("_all._self").alias("_self")).agg(F.min("_all.best").alias("_b"))
    return kept.where("_all is null").drop("_all").unionByName(more.select(*scope, "id", "kind", "at", "n", target(F.col("_b._id")), facts(F.col("_b._known")))), True


#: Ids of one block share all but these many bits; edges that are followed in one task at most.
BLOCK, TOGETHER = 14, 1 << 20


def _followed(edges: DataFrame, scope: list[str], whole: bool = False) -> DataFrame:
    """(scope, id, next, ends) of the edges whose path is not known to end: paths are followed as far as they stay among the
    edges of one block of ids, by pointer doubling over arrays, in memory that the block bounds. next is the id itself on paths
    that enter a cycle, else the first id of another block. An edge to itself is one that ends. With `whole` all edges are one
    block, and an edge to itself is a cycle.
    """

    def follow(table):
        import numpy as np
        import pyarrow as pa

        ids, nxt = table["id"].to_numpy(), table["next"].to_numpy()
        order = np.lexsort((nxt, ids))
        ids, at = np.unique(ids[order], return_index=True)  # repeats once
        nxt, n = nxt[order][at], len(ids)
        to = np.minimum(np.searchsorted(ids, nxt), n - 1)
        itself = nxt == ids
        onward = (ids[to] == nxt) & ~itself
        last = np.where(onward, to, np.arange(n))
        for _ in range(n.bit_length()):  # 2**k steps after k rounds; a path that ends has fewer than n
            last = last[last]
        ends = itself & (not whole)
        cycle = (onward | itself & whole)[last]
        far = np.where(cycle | ends, ids, nxt[last])
        stay = cycle | ends
        if not whole:
            stay |= far >> BLOCK != ids >> BLOCK
        names = pa.schema([*(table.schema.field(c) for c in scope), ("id", pa.int64()), ("next", pa.int64()), ("ends", pa.bool_())])
        ids, far, ends = ids[stay], far[stay], ends[stay]
        return pa.table([*(pa.array([table[c][0].as_py()] * len(ids), table.schema.field(c).type) for c in scope), pa.array(ids), pa.array(far), pa.array(ends)], schema=names)

    kinds = [f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in scope]
    block = F.lit(0) if whole else F.shiftright("id", BLOCK)
    rows = edges.where("id is not null and next is not null").select(*scope, "id", "next", block.alias("_block"))
    return rows.groupBy(*scope, "_block").applyInArrow(follow, ", ".join([*kinds, "id long, next long, ends boolean"]))


def cycle_ids(edges: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, id) of the nodes whose path over `edges` (scope, id, next; one next per id at most) enters a cycle, some more than
    once. An edge to itself is a cycle of its own; other paths end there.

    Pages of a series are mostly found one after another, so paths are first followed within blocks of ids, in one pass. What
    leads from block to block is followed in one task where it is little, else by pointer doubling until it is: after k rounds
    each node knows the node 2^k blocks on; those whose path ends before drop out. A path that ends after 2^k steps or more
    passes a node with just 2^k to go, which drops out in the next round. So a round without a loss shows that no path left
    ever ends.
    """
    near = checkpointed(_followed(edges, scope))
    away, found = near.where("id <> next"), near.where("id = next")
    left, before = away.count(), None
    if not left:
        return found.select(*scope, "id")
    met = found.where("not ends").join(away.select(*scope, F.col("next").alias("id")), [*scope, "id"], "left_semi")
    jump = away.select(*scope, "id", "next").unionByName(met.select(*scope, "id", "next"))
    while left > TOGETHER and left != before:
        ahead = jump.select(*scope, F.col("id").alias("next"), F.col("next").alias("_far"))
        jump = checkpointed(jump.join(ahead, [*scope, "next"]).select(*scope, "id", F.col("_far").alias("next")))
        left, before = jump.count(), left
    if left != before:
        jump = _followed(jump, scope, whole=True)
    return found.select(*scope, "id").unionByName(jump.select(*scope, "id"))


@dataclass(frozen=True)
class Resolved:
    """What reference questions about a crawl share, each made once."""

    attrs: DataFrame
    found: DataFrame
    several: bool  # whether a record may declare several targets of a kind


#: The kinds of targets that a flag asks for.
_KINDS = {f: ["canonical"] for f in CANONICAL} | {
    "next_to_error": ["next"], "prev_to_error": ["prev"], "next_loop": ["next"], "prev_loop": ["prev"], "next_non_reciprocal": ["next", "prev"], "prev_non_reciprocal": ["next", "prev"],
    "pagination_canonical_to_linked_page": ["canonical", "next", "prev"], "amp_to_error": ["amp"], "amp_non_reciprocal": ["amp"], "amp_target_missing_marker": ["amp"],
}


def resolved(records: DataFrame, scope: list[str], flags: tuple[str, ...] | list[str] = FLAGS, attrs: DataFrame | None = None, parts: tuple | None = None) -> Resolved:
    """Targets of the kinds that `flags` ask for; no others are resolved."""
    attrs = attributes(records, scope, not set(flags) & {"canonical_chain", "canonical_loop"}) if attrs is None else attrs
    kinds = [k for k in ("canonical", "next", "prev", "amp") if any(k in _KINDS[f] for f in flags)]
    return Resolved(attrs, *targets_of(attrs, scope, kinds, set(flags) == {"pagination_canonical_to_linked_page"}, len(flags) == 1 and flags[0] in RELATIONS and flags[0] != "amp_non_reciprocal", parts))


#: Flag: its kind of target and the kind of the way back.
_WAYS = {"next_non_reciprocal": ("next", "prev"), "prev_non_reciprocal": ("prev", "next")}


def one_way(attrs: DataFrame, scope: list[str], kind: str, other: str) -> DataFrame | None:
    """(scope, id) of records whose `kind` of target does not lead back, where all records are `_simple`; None if an address has
    several records. The index says where its records lead back to, so that one join tells nearly all; only a way back to
    another address has to be looked up, and few have one.
    """
    back = F.when(F.col("eligible") & (F.col(f"{other}_count") == 1), F.col(f"{other}_first"))
    rows = attrs.where("observed").select(F.hash("url").alias("_h"), *scope, F.col("url").alias("alias"), "id", "eligible", back.alias("_back"))
    # Shuffled first: grouped in the order in which they are joined, rows are sorted once.
    index = rows.repartition("_h", *scope, "alias").groupBy("_h", *scope, "alias").agg(F.min(F.struct("id", "eligible", "_back")).alias("_best"), F.max("id").alias("_last"))
    seen = Observation()
    index = index.observe(seen, F.count_if(F.col("_best.id") != F.col("_last")).alias("several"))
    text = F.col(f"{kind}_first")
    asked = attrs.where(F.col("eligible") & (F.col(f"{kind}_count") > 0) & (text != F.col("url"))).select(F.hash(text).alias("_h"), *scope, text.alias("alias"), "id", F.col("url").alias("_url"))
    met = asked.join(index, ["_h", *scope, "alias"]).where("_best.eligible").select(*scope, "id", "_url", "alias", "_best._back")
    away = met.where("_back is null or _back <> _url").select(*scope, "id", F.when(F.col("_back") != F.col("alias"), F.col("_back")).alias("alias"))
    away = checkpointed(away)
    if seen.get["several"]:
        return None
    known, open_ = away.where("alias is null").select(*scope, "id"), away.where("alias is not null")
    n = open_.count()
    if not n:
        return known
    names = attrs.where("observed").select(*scope, F.col("url").alias("alias"))
    names = sieve.sieved(names, open_, ["alias"]) if n < sieve.MOST_KEYS else names
    return known.unionByName(open_.join(names, [*scope, "alias"], "left_semi").select(*scope, "id"))


def _wide(rows: DataFrame, scope: list[str], flags: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*scope, "id").agg(*[F.bool_or(F.col("flag") == f).alias(f) for f in flags])


def marks(records: DataFrame, scope: list[str], flags: tuple[str, ...] | list[str] = FLAGS) -> DataFrame:
    """(scope, id, flag) of every one of `flags` that a record has, some more than once."""
    attrs = parts = None
    if len(flags) == 1 and flags[0] in _WAYS:
        attrs, (kind, other) = attributes(records, scope, True), _WAYS[flags[0]]
        parts = sorted_out(attrs, [kind, other])
        if parts[1] is None and (rows := one_way(attrs, scope, kind, other)) is not None:
            return rows.withColumn("flag", F.lit(flags[0]))
    base = resolved(records, scope, flags, attrs, parts)
    return reduce(DataFrame.unionByName, [*canonical_marks(base, scope, flags), *relation_marks(base, scope, flags)])


def canonical_flags(records: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, id, six canonical flags) of the records that have an absolute canonical."""
    base = resolved(records, scope, CANONICAL)
    rows = _wide(reduce(DataFrame.unionByName, canonical_marks(base, scope, CANONICAL)), scope, CANONICAL)
    all_rows = base.attrs.where(F.col("eligible") & _absolute()).select(*scope, "id")
    return all_rows.join(rows, [*scope, "id"], "left").select(*scope, "id", *[gates.sure(F.col(f)).alias(f) for f in CANONICAL])


def canonical_marks(base: Resolved, scope: list[str], flags) -> list[DataFrame]:
    """Parts (scope, id, flag) of the canonical flags asked for."""
    attrs, parts = base.attrs, []
    if not set(flags) & set(CANONICAL):
        return parts
    found = base.found.where("kind = 'canonical'")
    known = F.col("target").isNotNull() & has(FETCHED)
    own = {"canonical_uncrawled": ~known & has(NEAR), "canonical_to_redirect": known & has(REDIRECT), "canonical_to_error": known & has(BROKEN), "canonical_non_indexable": known & has(NON_INDEXABLE)}
    if asked := [f for f in own if f in flags]:
        parts.append(found.select(*scope, "id", F.explode(F.array(*[F.when(own[f], F.lit(f)) for f in asked])).alias("flag")).where("flag is not null"))
    if asked := [f for f in ("canonical_to_redirect", "canonical_non_indexable") if f in flags]:
        parts.append(self_canonicals(attrs, scope).where(F.col("flag").isin(asked)))
    if {"canonical_chain", "canonical_loop"} & set(flags):
        finals = attrs.select(*scope, "id", "final_url")
        edges = found.where(known & has(ELIGIBLE)).select(*scope, "id", "target").join(finals, [*scope, "id"]).join(finals.withColumnsRenamed({"id": "target", "final_url": "_final"}), [*scope, "target"])
        key = lambda c: F.coalesce(U.final_key(c), F.col(c))
        onward = checkpointed(edges.where(key("final_url") != key("_final")).select(*scope, "id", F.col("target").alias("next")))
        if "canonical_chain" in flags:
            far = found.select(*scope, F.col("id").alias("next"))
            parts.append(onward.join(far, [*scope, "next"], "left_semi").select(*scope, "id", F.lit("canonical_chain").alias("flag")))
        if "canonical_loop" in flags:
            parts.append(cycle_ids(onward, scope).withColumn("flag", F.lit("canonical_loop")))
    return parts


def relation_flags(records: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, id, the ten pagination and AMP flags) of the records that have any."""
    parts = relation_marks(resolved(records, scope, RELATIONS), scope, RELATIONS)
    return _wide(reduce(DataFrame.unionByName, parts), scope, RELATIONS)


def relation_marks(base: Resolved, scope: list[str], flags) -> list[DataFrame]:
    """Parts (scope, id, flag) of the pagination and AMP flags asked for. A record that declares one target, as most do, needs
    no grouping.
    """
    attrs, found, parts = base.attrs, base.found, []

    def add(flag: str, *rows: DataFrame) -> None:
        parts.extend(r.select(*scope, "id", F.lit(flag).alias("flag")) for r in rows)

    for kind, other, one, more in (("next", "prev", PREV_ONE, PREV_MORE), ("prev", "next", NEXT_ONE, NEXT_MORE)):
        known = found.where(F.col("kind") == kind)
        onward = known.where(has(ELIGIBLE) & (F.col("target") != F.col("id")))
        if f"{kind}_to_error" in flags:
            add(f"{kind}_to_error", known.where(has(ERROR)))
        if f"{kind}_loop" in flags:
            eligible = known.where(has(ELIGIBLE) & F.col("target").isNotNull()).select(*scope, "id", F.col("target").alias("next"), "n")
            if base.several:
                several = known.where("n > 1").groupBy(*scope, "id").agg(F.count_distinct("target").alias("_n"), F.count_if(F.col("target").isNull()).alias("_open"), F.min("target").alias("next"), F.bool_and(has(ELIGIBLE)).alias("_ok"))
                followed = eligible.where("n = 1 and next <> id").select(*scope, "id", "next").unionByName(several.where("_n = 1 and _open = 0 and _ok and next <> id").select(*scope, "id", "next"))
                loops = checkpointed(cycle_ids(followed, scope))
                add(f"{kind}_loop", loops, eligible.where("next = id"))
                # whose only target leads into a loop is among them already
                add(f"{kind}_loop", onward.where("n > 1").join(loops.withColumnRenamed("id", "target"), [*scope, "target"], "left_semi"))
            else:
                add(f"{kind}_loop", cycle_ids(eligible, scope))
        if f"{kind}_non_reciprocal" in flags:
            # Always so; with the same columns as onward's, the index is shuffled once for both.
            back = found.where(F.col("kind") == other).where("facts >= 0").select(*scope, F.col("id").alias("target"), F.col("target").alias("_back"), "n", "at")
            single = back.where("n = 1").groupBy(*scope, "target").agg(F.min("_back").alias("_back"))
            once = onward.where(~has(more)).select(*scope, "id", "target", has(one).alias("_one"))
            add(f"{kind}_non_reciprocal", once.join(single, [*scope, "target"], "left").where("not _one or _back <> id"))
            if base.several:
                mutual = onward.where(has(more)).select(*scope, "id", "target").distinct().join(back.where("n > 1").distinct(), [*scope, "target"]).groupBy(*scope, "id", "target").agg(
                    F.bool_or(gates.sure(F.col("_back") == F.col("id"))).alias("_returns"), F.count("_back").alias("_known"), F.max("n").alias("_declared")
                )
                add(f"{kind}_non_reciprocal", mutual.where("not _returns and _known = _declared"))
    amp = found.where("kind = 'amp'")
    if "amp_to_error" in flags:
        add("amp_to_error", amp.where(has(ERROR)))
    if "amp_target_missing_marker" in flags:
        add("amp_target_missing_marker", amp.where(has(ELIGIBLE) & has(UNMARKED)))
    if "amp_non_reciprocal" in flags:
        away = amp.where(has(ELIGIBLE) & (F.col("target") != F.col("id"))).select(*scope, "id", "target", "facts")
        able = attrs.where("eligible")
        named = able
        if not base.several:  # whose canonical is its own only address does not name another; few are left to be looked at
            add("amp_non_reciprocal", away.where(has(OWN)))
            away, named = away.where(~has(OWN)), able.where(~_canonical_is_own())
        ends = away.join(named.select(*scope, F.col("id").alias("target"), F.col("canonical").alias("_canonical")), [*scope, "target"]).select(*scope, "id", "_canonical").distinct()
        ends = ends.join(able.where(F.size("amp") > 0).select(*scope, "id", "url", "final_url"), [*scope, "id"])
        ends = checkpointed(ends.select(*scope, "id", "_canonical", "url", "final_url"))
        if not base.several:
            easy = blank("_canonical") | U.is_alone("_canonical")
            add("amp_non_reciprocal", ends.where(easy).where(blank("_canonical") | (F.col("_canonical") != F.col("url"))))
            ends = ends.where(~easy)
        if base.several or ends.count():
            ends = U.with_names(ends, _mine=["url", "final_url"], _names="_canonical")
            add("amp_non_reciprocal", ends.where(blank("_canonical") | (U.final_key("_canonical").isNotNull() & ~F.arrays_overlap("_names", "_mine"))))
    if "pagination_canonical_to_linked_page" in flags:
        canonical = found.where((F.col("kind") == "canonical") & has(ELIGIBLE) & has(OBSERVED)).select(*scope, "id", "target")
        linked = found.where("kind in ('next', 'prev') and target <> id").select(*scope, "id", "target")
        add("pagination_canonical_to_linked_page", canonical.join(linked, [*scope, "id", "target"], "left_semi"))
    return parts


def hreflang_flags(records: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, id, hreflang_missing_return, hreflang_non_canonical) of eligible records with any valid hreflang link.

    A link's target is the lowest record id among the aliases' lowest ids; unknown targets never flag.
    """
    base = records.select(*scope, "id", "canonical", "storage_key", "url", "final_url", gates.success_html().alias("eligible"), F.filter("hreflang_links", lambda x: x["valid"]).alias("_links"))
    base = unrepeated(base) if of_one_scan(records) else checkpointed(base.distinct())
    named = U.with_aliases(base.select(*scope, "id", "storage_key", "url", "final_url"), ["storage_key", "url", "final_url"]).select(*scope, "id", "alias")
    primary = named.groupBy(*scope, "alias").agg(F.min("id").alias("target"))
    links = checkpointed(U.with_aliases(base.where("size(_links) > 0").select(*scope, "id", F.posexplode("_links").alias("at", "_l")).select(*scope, "id", "at", F.col("_l.url").alias("_u")), ["_u"]).select(*scope, "id", "at", "alias"))
    own = links.join(named, [*scope, "id", "alias"], "left_semi").select(*scope, "id", "at").distinct()
    resolved = links.join(primary, [*scope, "alias"]).groupBy(*scope, "id", "at").agg(F.min("target").alias("target"))
    resolved = checkpointed(resolved)
    # A return link is a link of the target, one of whose aliases is an alias of the source.
    returns = links.join(named.withColumnRenamed("id", "source"), [*scope, "alias"]).select(*scope, F.col("id").alias("target"), F.col("source").alias("id")).distinct()
    missing = resolved.join(own, [*scope, "id", "at"], "left_anti").join(returns, [*scope, "id", "target"], "left_anti").select(*scope, "id").distinct().withColumn("hreflang_missing_return", F.lit(True))
    others = U.with_names(base.where(~blank("canonical")), _own=["storage_key", "url", "final_url"], _canonical="canonical")
    elsewhere = others.where(~F.arrays_overlap("_canonical", "_own")).select(*scope, F.col("id").alias("target"))
    wrong = resolved.join(elsewhere, [*scope, "target"], "left_semi").select(*scope, "id").distinct().withColumn("hreflang_non_canonical", F.lit(True))
    eligible = base.where("eligible").select(*scope, "id")
    return missing.join(wrong, [*scope, "id"], "full").join(eligible, [*scope, "id"], "left_semi").select(*scope, "id", gates.sure(F.col("hreflang_missing_return")).alias("hreflang_missing_return"), gates.sure(F.col("hreflang_non_canonical")).alias("hreflang_non_canonical"))
