"""One identity per physical unit across sources (G5, G6, W5, AG3, B15, B19).

1. Listings with the same exact key form a group (partial aggregation, so copies cost nothing).
2. Groups with the same address text join the earliest of them.
3. The earliest group of each distinct text looks for its most similar *earlier* text in the same
   city, in two levels. Texts with their digits masked ("herzl 00") are few; similar ones are found
   by an exact filter and compared first, and bound the similarity of the texts behind them. Texts
   of equal masks are then compared, and other pairs only where the bound can still match what a
   text has found. Nothing at or above the threshold is missed.
4. Links point from later to earlier, so they form trees; pointer jumping finds the roots.

Groups of earlier runs are kept as an index (``StoredUnits``): tables bucketed by the keys of the joins, which new
groups alone probe, so stored groups are neither shuffled nor compared with each other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.functions import similarity as sim
from hearthline.functions.text import (
    area_bucket, blank_to_null, canonical_id, canonicalize_address, let, rooms_bucket, street_number,
)
from hearthline.session import cut_lineage

THRESHOLD = 85
SHARED = 2


def key_parts(df: DataFrame) -> DataFrame:
    """Add street_n, number_n, rooms_b, sqm_b, city_n of a listing."""
    c = F.col
    where = F.coalesce(blank_to_null(c("street")), c("address") if "address" in df.columns else F.lit(""))
    return df.withColumn("_s", street_number(where)).withColumns({
        "street_n": canonicalize_address(c("_s.street")),
        "number_n": F.coalesce(blank_to_null(c("_s.number")), c("house_number"), F.lit("")),
        "rooms_b": rooms_bucket(c("rooms")), "sqm_b": area_bucket(c("sqm")),
        "city_n": canonicalize_address(c("city")),
    }).drop("_s")


def exact_key(include_city: bool = True) -> Column:
    """Key of rows that have passed ``key_parts``."""
    parts = ["street_n", "number_n", "rooms_b", "sqm_b"] + (["city_n"] if include_city else [])
    return canonical_id(F.concat_ws("|", *parts))


def exact_groups(df: DataFrame, include_city: bool = True) -> DataFrame:
    """G5 within a batch: every listing with the canonical id of its exact key."""
    return key_parts(df).withColumn("canonical_id", exact_key(include_city))


def representatives(grouped: DataFrame, order: Sequence[str] = ("first_seen_at", "source", "source_id")) -> DataFrame:
    """The earliest member of each group; aggregation starts before the shuffle."""
    fields = ["city_n", "street_n", "number_n", "rooms_b", "sqm_b", "city", "street", "house_number"]
    keep = [f for f in fields if f in grouped.columns]
    first = F.min(F.struct(F.struct(*order).alias("seen"), F.struct(*keep).alias("row")))
    return grouped.groupBy("canonical_id").agg(first.alias("_f"), F.count(F.lit(1)).alias("members")).select(
        "canonical_id", "members", F.col("_f.seen").alias("seen"), "_f.row.*"
    )


# ---- similarity join --------------------------------------------------------

def _tokens(text: Column) -> Column:
    """Characters with the number of their occurrence, as a set: 'anna' -> a1 n1 n2 a2, each one BIGINT."""
    def numbered(letters: Column) -> Column:
        return F.transform(letters, lambda ch, i: (
            F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == ch)).cast("bigint") * (1 << 21) + F.ascii(ch)
        ))
    return let(sim.chars(text), numbered)


def _head(text: Column, city: Column, percent: int) -> Column:
    """First tokens of a text in an order that all texts of its city share.

    Two texts of similarity s share at least o = s*(la+lb)/2 tokens, so the first len-o+2 tokens of both have
    two in common; one token that every text has stands last for texts that need a single common one. The
    city's own tokens go last, later occurrences of a character, which fewer texts have, first.
    """
    n = F.char_length(text)
    shortest = F.ceil(n * percent / (200 - percent))
    needed = F.ceil((n + shortest) * percent / 200)

    def ordered(of_city: Column) -> Column:
        rank = lambda t: F.struct(
            F.array_contains(of_city, t).alias("of_city"), (-F.shiftright(t, 21)).alias("nth"), F.xxhash64(t).alias("h"), t.alias("t"))
        own = F.transform(F.array_sort(F.transform(_tokens(text), rank)), lambda t: t["t"])
        return F.slice(F.array_append(own, F.lit(0).cast("bigint")), F.lit(1), (n - needed + SHARED).cast("int"))

    return let(_tokens(city), ordered)


def head_pairs(nodes: DataFrame, percent: int, keep: Sequence[str] = ()) -> DataFrame:
    """(city_n, node, head, t1, t2): each text once for every pair of its head tokens."""
    heads = nodes.select("city_n", F.struct("text", *keep).alias("node"), _head(F.col("text"), F.col("city_n"), percent).alias("head"))
    pairs = lambda a: F.flatten(F.transform(
        a, lambda x, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda y: F.struct(x.alias("t1"), y.alias("t2")))
    ))
    return heads.select("city_n", "node", "head", F.inline(let(F.col("head"), pairs)))


def _meeting(x: DataFrame, y: DataFrame, percent: int, wanted: Column) -> DataFrame:
    """(city_n, x, y) of two sides of ``head_pairs`` that share two head tokens, each pair of texts once."""
    common = F.array_intersect("x_head", "y_head")
    return (
        x.withColumnsRenamed({"node": "x", "head": "x_head"})
        .join(y.withColumnsRenamed({"node": "y", "head": "y_head"}), ["city_n", "t1", "t2"])
        .filter(wanted & sim.length_gate(F.col("x.text"), F.col("y.text"), percent))
        .filter(let(common, lambda both: (F.get(both, F.lit(0)) == F.col("t1")) & (F.get(both, F.lit(1)) == F.col("t2"))))
        .select("city_n", "x", "y")
    )


def candidates(nodes: DataFrame, percent: int, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs of distinct texts of a city, columns (city_n, x, y) with x and y structs of ``keep`` and text.

    Each pair that reaches the similarity is among them, once in either order of its texts (x.text > y.text).
    The join key is a pair of head tokens; cities of every size go the same way. ``nodes``: text, city_n, keep.
    """
    signed = _spread(head_pairs(nodes, percent, keep), "city_n", "t1", "t2")
    return _meeting(signed, signed, percent, F.col("x.text") > F.col("y.text"))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """One exchange by key into the session's number of partitions: a join of pairs is far larger than the input
    by which partitions would be coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _masked(text: Column) -> Column:
    """Text with its digits alike: common subsequences only grow, lengths stay."""
    return F.translate(text, "0123456789", "0" * 10)


def _above(a: Column, b: Column, percent: int, bits: Column | None = None) -> Column:
    """Similarity of two texts as an array, empty below the threshold: explode it to filter and evaluate once."""
    total = F.char_length(a) + F.char_length(b)
    return F.transform(
        F.filter(F.array(sim.lcs_length(a, b, bits)), lambda lcs: lcs * 200 >= total * percent), lambda lcs: lcs * 2 / total)


def _mask_pairs(nodes: DataFrame, percent: int, stored_heads: DataFrame | None = None) -> DataFrame:
    """(city_n, mask, other, bound): similar masks of a city, from each mask of ``nodes`` to those of nodes and of stored texts.

    A mask and itself are left out.
    """
    a, b = F.col("x.text"), F.col("y.text")
    masks = nodes.select("city_n", F.col("mask").alias("text")).distinct()

    def measured(pairs: DataFrame) -> DataFrame:
        return pairs.filter(sim.levenshtein_gate(a, b, percent)).select(
            "city_n", a.alias("a"), b.alias("b"), F.explode(_above(a, b, percent)).alias("bound"))

    both = F.array(F.struct(F.col("a").alias("mask"), F.col("b").alias("other")), F.struct(F.col("b").alias("mask"), F.col("a").alias("other")))
    found = measured(candidates(masks, percent)).select("city_n", "bound", F.inline(both))
    if stored_heads is None:
        return found
    met = measured(_meeting(head_pairs(masks, percent), stored_heads, percent, a != b))
    return found.unionByName(met.withColumnsRenamed({"a": "mask", "b": "other"})).distinct()


def _compared(pairs: DataFrame, percent: int) -> DataFrame:
    """(id, parent, parent_seen, similarity) of the pairs (id, text, bits, y_id, y_text, y_seen) above the threshold."""
    a, b = F.col("text"), F.col("y_text")
    return pairs.filter(sim.length_gate(a, b, percent)).filter(sim.levenshtein_gate(a, b, percent)).select(
        "id", F.col("y_id").alias("parent"), F.col("y_seen").alias("parent_seen"),
        F.explode(_above(a, b, percent, F.col("bits"))).alias("similarity"))


def _levels(
    nodes: DataFrame, percent: int, block: Sequence[str], known: StoredUnits | None = None
) -> tuple[DataFrame, list[DataFrame], DataFrame, DataFrame]:
    """(later texts, sides of earlier texts, pairs of equal masks, pairs of masks) of the two-level join."""
    cut = nodes.select("id", "text", "seen", *dict.fromkeys(["city_n", *block])).withColumn("mask", _masked(F.col("text")))
    later = cut_lineage(_spread(cut, "id").withColumn("bits", sim.char_masks(F.col("text"))))
    sides = [side.select(*block, F.col("mask").alias("other"), F.col("id").alias("y_id"), F.col("text").alias("y_text"),
                         F.col("seen").alias("y_seen")) for side in [later] + ([known.texts] if known else [])]
    alike = _meet(later.withColumn("other", F.col("mask")), sides, block)
    return later, sides, alike, cut_lineage(_mask_pairs(cut, percent, known.heads if known else None))


def _meet(later: DataFrame, sides: list[DataFrame], block: Sequence[str]) -> DataFrame:
    """Later texts with the earlier ones of every side that have their block and the mask ``other``."""
    met = None
    for side in sides:
        one = later.join(side.hint("merge"), [*block, "other"]).filter(F.col("seen") > F.col("y_seen"))
        met = one if met is None else met.unionByName(one)
    return met


def similar_pairs(
    nodes: DataFrame, percent: int = THRESHOLD, block: Sequence[str] = ("city_n",)
) -> DataFrame:
    """All (later, earlier) pairs of distinct texts in a block at or above the threshold.

    ``nodes``: id, text, city_n, seen (sortable) and the block columns, city_n among them; texts differ within
    a block. ``best_earlier`` is the cheaper way to the best partner of each text.
    """
    later, sides, alike, masks = _levels(nodes, percent, block)
    others = _meet(later.join(masks, ["city_n", "mask"]), sides, block)
    return _compared(alike, percent).unionByName(_compared(others, percent))


def best_earlier(
    nodes: DataFrame, percent: int = THRESHOLD, block: Sequence[str] = ("city_n",), known: StoredUnits | None = None
) -> DataFrame:
    """(id, parent, similarity): most similar earlier text of each text; the earliest wins ties.

    Texts of equal masks are compared first. Another mask is only looked at if its bound is not below what a
    text has found, so a text with a near neighbour in its own street is not compared with other streets.
    Texts of ``known`` (with a column seen) are partners, too, but look for none.
    """
    later, sides, alike, masks = _levels(nodes, percent, block, known)
    near = cut_lineage(_best(_compared(alike, percent)))
    found = near.select("id", F.col("_b.s").alias("least"))
    open_ = later.join(found, "id", "left").join(masks, ["city_n", "mask"]).filter(
        F.col("bound") >= F.coalesce(-F.col("least"), F.lit(0.0)))
    others = _meet(open_, sides, block)
    return _chosen(near.unionByName(_best(_compared(others, percent))).groupBy("id").agg(F.min("_b").alias("_b")))


def _best(pairs: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "parent_seen", "parent"))
    return pairs.groupBy("id").agg(best.alias("_b"))


def _chosen(best: DataFrame) -> DataFrame:
    return best.select("id", F.col("_b.parent").alias("parent"), (-F.col("_b.s")).alias("similarity"))


def roots(links: DataFrame) -> DataFrame:
    """Pointer jumping over (id, parent): ceil(log2(depth)) rounds, each round checkpointed."""
    current = cut_lineage(links.select("id", "parent"))
    while True:
        up = current.select(F.col("id").alias("_id"), F.col("parent").alias("_grand"))
        jumped = cut_lineage(
            current.join(up, F.col("parent") == F.col("_id"), "left").select(
                "id", F.coalesce("_grand", "parent").alias("parent"), F.col("_grand").isNotNull().alias("moved")
            )
        )
        current = jumped.select("id", "parent")
        if jumped.filter("moved").isEmpty():
            return current.withColumnRenamed("parent", "root")


@dataclass(frozen=True)
class StoredUnits:
    """Groups of earlier runs, laid out for the joins that new groups probe them with.

    ``keys``: exact_id, canonical_id. ``texts``: city_n (rooms_b, sqm_b), mask, text, id; one row for each distinct
    text of a block. ``heads``: ``head_pairs`` of the distinct masks. The three rules are those of ``resolve``.
    """

    keys: DataFrame
    texts: DataFrame
    heads: DataFrame
    percent: int = THRESHOLD
    include_city: bool = True
    same_buckets: bool = False

    @property
    def block(self) -> list[str]:
        return ["city_n", "rooms_b", "sqm_b"] if self.same_buckets else ["city_n"]


GROUP_PARTS = ("city_n", "street_n", "number_n", "rooms_b", "sqm_b")
#: Before the ids of stored groups while links are followed: they are roots, even where a new group has the same id.
STORED_MARK = "="


def _unit_text() -> Column:
    return F.concat_ws(" ", *[blank_to_null(F.col(n)) for n in ("city_n", "street_n", "number_n")])


def stored_units(
    stored: DataFrame, *, percent: int = THRESHOLD, include_city: bool = True, same_buckets: bool = False
) -> StoredUnits:
    """Index of groups (canonical_id, city_n, street_n, number_n, rooms_b, sqm_b); the smallest id of a key or text counts.

    Groups without any address text are found by their key alone.
    """
    groups = cut_lineage(
        stored.select("canonical_id", *GROUP_PARTS).withColumns({"exact_id": exact_key(include_city), "text": _unit_text()}))
    block = ["city_n", "rooms_b", "sqm_b"] if same_buckets else ["city_n"]
    keys = groups.groupBy("exact_id").agg(F.min("canonical_id").alias("canonical_id"))
    texts = groups.filter(F.col("text") != "").groupBy(*block, _masked(F.col("text")).alias("mask"), "text").agg(
        F.min("canonical_id").alias("id"))
    masks = groups.filter(F.col("text") != "").select("city_n", _masked(F.col("text")).alias("text")).distinct()
    return StoredUnits(keys, texts, head_pairs(masks, percent), percent, include_city, same_buckets)


def _unit_tables(name: str, percent: int, include_city: bool, same_buckets: bool) -> tuple[str, str, str]:
    rules = f"{percent}{'_city' if include_city else ''}{'_sized' if same_buckets else ''}"
    return f"{name}_keys_{rules}", f"{name}_texts_{rules}", f"{name}_heads_{rules}"


def save_units(units: StoredUnits, name: str, buckets: int = 64, mode: str = "errorifexists") -> StoredUnits:
    """Write the index as bucketed tables, whose names carry the rules, and return it read from them."""
    tables = _unit_tables(name, units.percent, units.include_city, units.same_buckets)
    layout = (units.keys, ["exact_id"]), (units.texts, [*units.block, "mask"]), (units.heads, ["city_n", "t1", "t2"])
    for table, (frame, by) in zip(tables, layout):
        frame.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).mode(mode).saveAsTable(table)
    return load_units(units.keys.sparkSession, name, percent=units.percent, include_city=units.include_city, same_buckets=units.same_buckets)


def load_units(
    spark: SparkSession, name: str, *, percent: int = THRESHOLD, include_city: bool = True, same_buckets: bool = False
) -> StoredUnits:
    """A saved index; one that was saved under other rules is not found."""
    frames = map(spark.table, _unit_tables(name, percent, include_city, same_buckets))
    return StoredUnits(*frames, percent, include_city, same_buckets)


def extend_units(units: StoredUnits, name: str, resolved: DataFrame, buckets: int = 64) -> StoredUnits:
    """Append the groups of ``resolved`` (rows of ``resolve``) that a saved index lacks; files of the old ones stay."""
    groups = resolved.select("canonical_id", *GROUP_PARTS).distinct()
    new = stored_units(groups, percent=units.percent, include_city=units.include_city, same_buckets=units.same_buckets)
    mask = F.col("node.text")
    lacking = StoredUnits(
        cut_lineage(new.keys.join(units.keys, "exact_id", "left_anti")),
        cut_lineage(new.texts.join(units.texts, [*units.block, "mask", "text"], "left_anti")),
        cut_lineage(new.heads.withColumn("_m", mask).join(
            units.heads.select("city_n", "t1", "t2", mask.alias("_m")), ["city_n", "t1", "t2", "_m"], "left_anti").drop("_m")),
        units.percent, units.include_city, units.same_buckets)
    return save_units(lacking, name, buckets, "append")


def resolve(
    listings: DataFrame, stored: DataFrame | StoredUnits | None = None, *, percent: int = THRESHOLD,
    include_city: bool = True, same_buckets: bool = False,
) -> DataFrame:
    """Canonical id for every listing. ``stored`` holds the groups known before: canonical_id,
    city_n, street_n, number_n, rooms_b, sqm_b, or an index of them made with the same rules; they precede every
    batch group and keep their id. Only new texts look for partners."""
    rules = {"percent": percent, "include_city": include_city, "same_buckets": same_buckets}
    known = stored_units(stored, **rules) if isinstance(stored, DataFrame) else stored
    if known is not None and {k: getattr(known, k) for k in rules} != rules:
        raise ValueError("the index of stored groups was made with other rules")
    block = ["city_n", "rooms_b", "sqm_b"] if same_buckets else ["city_n"]
    # groups and the last join both need the keys, which cost more than writing them once
    keyed = cut_lineage(key_parts(listings).withColumn("exact_id", exact_key(include_city)))
    batch = representatives(keyed.withColumn("canonical_id", F.col("exact_id")))
    rank = F.struct(F.lit(1).alias("order"), F.struct(
        F.col("seen.first_seen_at").alias("a"), F.col("seen.source").alias("b"), F.col("seen.source_id").alias("c")))
    groups = batch.select("canonical_id", *GROUP_PARTS, rank.alias("seen"), F.col("canonical_id").alias("exact_id"))
    if known is not None:
        named = cut_lineage(groups.join(known.keys.select("exact_id", F.col("canonical_id").alias("_stored_id")), "exact_id", "left"))
        groups = named.filter(F.col("_stored_id").isNull()).drop("_stored_id")
        named = named.filter(F.col("_stored_id").isNotNull())
        first = F.struct(F.lit(0).alias("order"), F.struct(
            F.lit(None).cast(listings.schema["first_seen_at"].dataType).alias("a"), F.lit("").alias("b"), F.col("id").alias("c")))
        known = replace(known, texts=known.texts.withColumn("seen", first).withColumn("id", F.concat(F.lit(STORED_MARK), "id")))
    texted = cut_lineage(groups.withColumn("text", _unit_text()))
    node_key = [*block, "text"]
    nodes = cut_lineage(texted.groupBy(*node_key).agg(F.min(F.struct("seen", "canonical_id")).alias("_f")).select(
        *node_key, F.col("_f.seen").alias("seen"), F.col("_f.canonical_id").alias("id")
    ).filter(F.col("text") != ""))
    top = roots(best_earlier(nodes, percent, block, known))
    # group -> node of its text -> root of the node; stored groups keep their own id
    of_node = nodes.select(*node_key, F.col("id").alias("_node")).join(
        top.select(F.col("id").alias("_node"), F.ltrim("root", F.lit(STORED_MARK)).alias("root")), "_node", "left"
    )
    final = texted.join(of_node, node_key, "left").select(
        "exact_id", F.coalesce("root", "_node", "canonical_id").alias("canonical_id")
    )
    if known is not None:
        final = final.unionByName(named.select("exact_id", F.col("_stored_id").alias("canonical_id")))
    return keyed.drop("canonical_id").join(final, "exact_id", "left")


# ---- groups -----------------------------------------------------------------

def group_summary(df: DataFrame) -> DataFrame:
    """AG3: size, spread, cheapest and dearest member, sources."""
    c = F.col
    tie = F.struct("price", "source", "source_id")
    high = F.struct((-c("price")).alias("p"), c("source"), c("source_id"))
    return df.groupBy("canonical_id").agg(
        F.count(F.lit(1)).alias("member_count"),
        (F.max("price") - F.min("price")).alias("price_spread"),
        F.min(F.struct(tie.alias("k"), c("url"))).alias("_low"),
        F.min(F.struct(high.alias("k"), c("url"))).alias("_high"),
        F.sort_array(F.collect_set("source")).alias("sources"),
    ).select(
        "canonical_id", "member_count", "price_spread",
        c("_low.k.price").alias("cheapest_price"), c("_low.k.source").alias("cheapest_source"),
        c("_low.url").alias("cheapest_url"), (-c("_high.k.p")).alias("dearest_price"),
        c("_high.k.source").alias("dearest_source"), "sources",
    )


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Groups with several members, widest spread first."""
    return group_summary(df).filter(F.col("member_count") > 1).orderBy(
        F.desc("price_spread"), "canonical_id"
    )
