"""A user's types of map objects: which tags make which type, and what raw objects become.

Types are an ordered list; the first whose condition holds wins. Conditions are Column factories over a tag map
(functions.features has the comparisons), combined with & | ~ as usual.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import exists, flag, is_in, tag

IGNORED = "ignored"


@dataclass(frozen=True)
class ObjectType:
    """kinds: which of node, way, area and relation the condition makes. pin_way: never an area by being closed."""

    name: str
    condition: Callable[[Column], Column]
    kinds: tuple[str, ...]
    groups: tuple[str, ...] = ()
    pin_way: bool = False
    routable: tuple[str, ...] = ()
    index_as: tuple[str, ...] = ()
    features: tuple[str, ...] = ()


class Types:
    """An ordered set of types."""

    def __init__(self, *types: ObjectType):
        self.types = types

    def with_types(self, *more: ObjectType) -> Types:
        """The same with further types behind."""
        return Types(*self.types, *more)

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """One row for each type, in order."""
        rows = [(k, t.name, list(t.kinds), list(t.groups), t.pin_way, list(t.routable), list(t.index_as), list(t.features)) for k, t in enumerate(self.types)]
        return spark.createDataFrame(rows, "ordinal int, name string, kinds array<string>, groups array<string>, pin_way boolean, routable array<string>, index_as array<string>, features array<string>")

    def _first(self, tags: Column, kind: str) -> Column:
        found = F.lit(None).cast("string")
        for t in reversed(self.types):
            if kind in t.kinds:
                found = F.when(t.condition(tags), t.name).otherwise(found)
        return F.when(F.size(tags) > 0, found)

    def node_type(self, tags: Column) -> Column:
        return F.coalesce(self._first(tags, "node"), F.lit(IGNORED))

    def way_and_area_type(self, tags: Column) -> Column:
        """struct<way, area>: the first type of either kind whose condition holds gives both; its other kinds stay ignored."""
        found = F.struct(F.lit(IGNORED).alias("way"), F.lit(IGNORED).alias("area"))
        ignored = found
        for t in reversed(self.types):
            way, area = "way" in t.kinds, "area" in t.kinds
            if way or area:
                own = F.struct(F.lit(t.name if way else IGNORED).alias("way"), F.lit(t.name if area else IGNORED).alias("area"))
                found = F.when(t.condition(tags), own).otherwise(found)
        return F.when(F.size(tags) > 0, found).otherwise(ignored)

    def relation_type(self, tags: Column) -> Column:
        """Multipolygons are typed as areas, other relations by relation conditions."""
        return F.coalesce(F.when(is_in(tags, "type", "multipolygon"), self._first(tags, "area")).otherwise(self._first(tags, "relation")), F.lit(IGNORED))

    def names(self, where: Callable[[ObjectType], bool]) -> list[str]:
        """Names of the types with a property, such as those that a car may use."""
        return [t.name for t in self.types if where(t)]

    def in_group(self, group: str) -> list[str]:
        return self.names(lambda t: group in t.groups)


def way_or_area(ways: DataFrame, types: Types) -> DataFrame:
    """Raw ways (way_id, refs, tags) with kind (way or area), type and refs; ways of fewer than two refs go.

    The area tag decides; roundabouts and pinned types are ways; else a closed way of more than three refs is an area. The closing ref of an area is dropped.
    """
    tags, refs = F.col("tags"), F.col("refs")
    pinned = types.names(lambda t: t.pin_way)
    both = ways.where(F.size("refs") >= 2).withColumn("af_types", types.way_and_area_type(tags))
    closed = (F.size(refs) > 3) & (F.element_at(refs, 1) == F.element_at(refs, -1))
    said = F.when(is_in(tags, "junction", "roundabout"), False).when(exists(tags, "area"), flag(tags, "area"))
    area = F.coalesce(said, F.when(F.col("af_types.way").isin(pinned) if pinned else F.lit(False), False).otherwise(closed))
    return both.withColumn("af_area", area).withColumns({"kind": F.when(F.col("af_area"), "area").otherwise("way"), "type": F.when(F.col("af_area"), F.col("af_types.area")).otherwise(F.col("af_types.way")), "refs": F.when(F.col("af_area") & closed, F.slice(refs, F.lit(1), F.size(refs) - 1)).otherwise(refs)}).drop("af_types", "af_area")


def is_multipolygon(tags: Column) -> Column:
    return is_in(tags, "type", "multipolygon", "boundary")


def is_route(tags: Column) -> Column:
    return is_in(tags, "type", "route")


def is_route_master(tags: Column) -> Column:
    return is_in(tags, "type", "route_master")


#: Restrictions that are understood; all others are not restrictions.
ALLOWING = ("only_left_turn", "only_right_turn", "only_straight_on")
FORBIDDING = ("no_left_turn", "no_right_turn", "no_straight_on", "no_u_turn")


def restriction_kind(tags: Column) -> Column:
    """allow, forbid or null."""
    r = tag(tags, "restriction")
    return F.when(is_in(tags, "type", "restriction"), F.when(r.isin(*ALLOWING), "allow").when(r.isin(*FORBIDDING), "forbid"))


# ---- sets of types, as array<string>


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def without(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def shared(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


#: A small catalogue to begin with.
DEFAULT = Types(
    ObjectType("highway_motorway", lambda t: is_in(t, "highway", "motorway"), ("way",), ("routing",), True, ("car",), (), ("name", "ref", "access", "max_speed", "lanes")),
    ObjectType("highway_primary", lambda t: is_in(t, "highway", "primary", "primary_link"), ("way",), ("routing",), True, ("foot", "bicycle", "car"), ("location",), ("name", "ref", "access", "max_speed", "lanes")),
    ObjectType("highway_residential", lambda t: is_in(t, "highway", "residential", "living_street"), ("way", "area"), ("routing",), True, ("foot", "bicycle", "car"), ("location",), ("name", "access", "max_speed")),
    ObjectType("highway_footway", lambda t: is_in(t, "highway", "footway", "path", "pedestrian"), ("way", "area"), ("routing",), False, ("foot", "bicycle"), ("location",), ("name", "access", "grade")),
    ObjectType("building", lambda t: flag(t, "building"), ("area",), (), False, (), ("address",), ("name", "address", "location")),
    ObjectType("amenity_library", lambda t: is_in(t, "amenity", "library"), ("node", "area"), ("public",), False, (), ("poi",), ("name", "opening_hours", "website")),
    ObjectType("shop", lambda t: exists(t, "shop"), ("node", "area"), ("shopping",), False, (), ("poi",), ("name", "opening_hours", "brand")),
    ObjectType("boundary", lambda t: is_in(t, "boundary", "administrative"), ("way", "area", "relation"), (), False, (), ("region",), ("name", "admin_level")),
    ObjectType("natural_water", lambda t: is_in(t, "natural", "water"), ("area",), (), False, (), (), ("name",)),
    ObjectType("route_bus", lambda t: is_in(t, "route", "bus") & is_route(t), ("relation",), (), False, (), (), ("name", "ref", "colour")),
)
