"""Typed features of map objects from their tags (map<string, string>), as Column expressions.

A feature is null where the tags give none. A missing tag fails every comparison, that for inequality too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lane_turns, split_list, to_number

#: Bits of access in the two directions, and of one-way streets.
FOOT_FORWARD, FOOT_BACKWARD, BICYCLE_FORWARD, BICYCLE_BACKWARD, CAR_FORWARD, CAR_BACKWARD, ONEWAY_FORWARD, ONEWAY_BACKWARD = (1 << k for k in range(8))
FOOT, BICYCLE, CAR = FOOT_FORWARD | FOOT_BACKWARD, BICYCLE_FORWARD | BICYCLE_BACKWARD, CAR_FORWARD | CAR_BACKWARD
#: Speeds that names of places stand for.
SPEED_ALIASES = {"DE:urban": 50, "DE:rural": 100, "DE:motorway": 130, "DE:living_street": 7, "FR:urban": 50, "FR:rural": 80, "FR:motorway": 130, "IT:urban": 50, "IT:rural": 90, "IT:motorway": 130, "CZ:urban": 50, "CZ:rural": 90, "CZ:motorway": 130}
#: Kinds of surface by their grade.
SURFACE_GRADES = {"paved": 1, "asphalt": 1, "concrete": 1, "paving_stones": 1, "sett": 2, "cobblestone": 2, "compacted": 2, "fine_gravel": 2, "gravel": 3, "pebblestone": 3, "unpaved": 4, "ground": 4, "dirt": 4, "earth": 4, "grass": 5, "mud": 5, "sand": 5}


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


# ---- conditions


def exists(tags: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, key), F.lit(False))


def compare(tags: Column, key: str, op: str, value: str | int) -> Column:
    """op is one of < <= == != >= >. Texts compare by bytes; with a number, values that are not unsigned numbers fail."""
    own = tag(tags, key)
    if isinstance(value, int):
        own = F.when(F.regexp_like(own, F.lit(r"^\d+$")), own.try_cast("long"))
    return F.coalesce({"<": own < value, "<=": own <= value, "==": own == value, "!=": own != value, ">=": own >= value, ">": own > value}[op], F.lit(False))


def is_in(tags: Column, key: str, *values: str) -> Column:
    return F.coalesce(tag(tags, key).isin(*values), F.lit(False))


def flag(tags: Column, key: str) -> Column:
    """Set, and not to no, false or 0."""
    return F.coalesce(~tag(tags, key).isin("no", "false", "0"), F.lit(False))


# ---- single values


def name(tags: Column, languages: tuple[str, ...] = ()) -> Column:
    """The name in the first language that has one, else the plain name."""
    return F.coalesce(*[tag(tags, f"name:{x}") for x in languages], tag(tags, "name"))


def _speed(text: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for kv in SPEED_ALIASES.items() for x in kv])
    mph = F.contains(text, F.lit("mph"))
    plain = F.rtrim(F.regexp_replace(text, r"(mph|km/h).*$", ""))
    number = F.coalesce(F.when(F.regexp_like(plain, F.lit(r"^\d+$")), plain.try_cast("long")), F.try_element_at(aliases, plain).cast("long"))
    # A mile counts as 2 km where the cap of one byte is tested, as 1.609 km in the value.
    value = F.when(mph, F.when(number > 255 // 2, 255).otherwise(F.round(number * 1.609))).otherwise(F.least(number, F.lit(255)))
    return F.when(text.isin("signals", "none", "no"), None).when(text == "walk", 10).when(number.isNotNull(), value).cast("int")


def max_speed(tags: Column) -> Column:
    """km/h, 255 at most. The smaller of the two directions if both are given; none if either can't be read."""
    both, forward, backward = tag(tags, "maxspeed"), tag(tags, "maxspeed:forward"), tag(tags, "maxspeed:backward")
    f, b = _speed(forward), _speed(backward)
    return F.when(forward.isNotNull() & backward.isNotNull(), F.when(f.isNotNull() & b.isNotNull(), F.least(f, b))).when(forward.isNotNull(), f).when(backward.isNotNull(), b).otherwise(_speed(both))


def _metres(text: Column) -> Column:
    """A number with one comma or point, and perhaps m behind it."""
    point = F.when(F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) == 1, F.replace(text, F.lit(","), F.lit("."))).otherwise(text)
    return to_number(F.rtrim(F.regexp_replace(point, r"(?<=[0-9 ])m$", "")), "double")


def width(tags: Column) -> Column:
    """Whole metres from 0 to 255, rounded up at the half."""
    w = _metres(tag(tags, "width"))
    return F.when((w >= 0) & (w <= 255.5), F.least(F.floor(w + 0.5), F.lit(255))).cast("int")


def elevation(tags: Column) -> Column:
    """Whole metres."""
    return F.floor(_metres(tag(tags, "ele")) + 0.5).cast("int")


def layer(tags: Column) -> Column:
    """From -128 to 127; layer 0 is none."""
    n = to_number(tag(tags, "layer"), "int")
    return F.when((n != 0) & n.between(-128, 127), n)


def grade(tags: Column) -> Column:
    """1 (solid) to 5, of the kind of track, else of the surface."""
    track = F.regexp_extract(tag(tags, "tracktype"), "^grade([1-5])$", 1).try_cast("int")
    return F.coalesce(track, F.try_element_at(F.create_map(*[F.lit(x) for kv in SURFACE_GRADES.items() for x in kv]), tag(tags, "surface")))


def admin_level(tags: Column) -> Column:
    n = to_number(tag(tags, "admin_level"), "int")
    return F.when(n.isNotNull(), F.struct(n.alias("level"), F.coalesce(tag(tags, "is_in"), F.lit("")).alias("is_in")))


def construction_year(tags: Column) -> Column:
    """struct<start, end> of a year or a range of years; a tilde before it and a C before a century are read."""
    text = F.regexp_replace(F.coalesce(tag(tags, "year_of_construction"), tag(tags, "start_date")), "^~", "")
    one, pair = to_number(text, "int"), lambda k: to_number(F.regexp_extract(text, r"^(\d+)-(\d+)$", k), "int")
    century = to_number(F.regexp_extract(text, r"^C(\d+)$", 1), "int")
    year = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    return F.when(one.isNotNull(), year(one, one)).when(pair(1).isNotNull(), year(pair(1), pair(2))).when(century.isNotNull(), year((century - 1) * 100, (century - 1) * 100 + 99))


def milestone(tags: Column) -> Column:
    """struct<distance, ref, carriageway_ref, marker>: metres (0 if the distance can't be read). Plain numbers are kilometres."""
    text = F.trim(tag(tags, "distance"))
    unit = F.regexp_extract(text, r"^(.*?)\s*(km|mi|m)?$", 2)
    number = to_number(F.trim(F.regexp_extract(text, r"^(.*?)\s*(km|mi|m)?$", 1)), "double")
    factor = F.when(unit == "m", 1.0).when(unit == "mi", 1609.344).otherwise(1000.0)
    metres = F.when((number >= 0) & (number <= 4294967295 / factor), F.floor(number * factor))
    ref = lambda key: F.coalesce(tag(tags, key), F.lit(""))
    return F.struct(F.coalesce(metres, F.lit(0)).cast("long").alias("distance"), ref("ref").alias("ref"), ref("carriageway_ref").alias("carriageway_ref"), ref("marker").alias("marker"))


def sideway(tags: Column) -> Column:
    """Bits: pavement left, right, cycle lane left, right, cycle track left, right; null without any."""
    walk, left, right = tag(tags, "sidewalk"), tag(tags, "cycleway:left"), tag(tags, "cycleway:right")
    tests = (walk.isin("left", "both"), walk.isin("right", "both"), left.isin("lane", "shared_lane"), right.isin("lane", "shared_lane"), left == "track", right == "track")
    return F.nullif(reduce(lambda a, b: a + b, [F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)]), F.lit(0))


def lanes(tags: Column, usual: int = 2, usual_oneway: int = 1) -> Column:
    """struct<forward, backward, turn_forward, turn_backward, destination_forward, destination_backward>.

    None without the number of lanes (or both directions' numbers), with numbers that can't be read, and where the number is the
    type's usual one and nothing else is known. A single lane of a two-way road counts for neither direction.
    """
    number = {k: to_number(tag(tags, k), "int") for k in ("lanes", "lanes:forward", "lanes:backward")}
    readable = reduce(lambda a, b: a & b, [~exists(tags, k) | number[k].between(0, 255) for k in number])
    n, f, b = (F.coalesce(number[k], F.lit(0)) for k in number)
    oneway = flag(tags, "oneway")
    has = {k: exists(tags, k) for k in number}
    forward = F.when(has["lanes:forward"], f).when(has["lanes:backward"], n - b).when(oneway, n).otherwise(F.floor(n / 2))
    backward = F.when(has["lanes:backward"], b).when(has["lanes:forward"], n - f).when(oneway, 0).otherwise(F.floor(n / 2))
    either = lambda *keys: F.coalesce(*[tag(tags, k) for k in keys])
    turn_f, turn_b = either("turn:lanes:forward", "turn:lanes"), either("turn:lanes:backward")
    goal_f, goal_b = either("destination:lanes:forward", "destination:lanes"), either("destination:lanes:backward")
    more = F.coalesce(turn_f, turn_b, goal_f, goal_b).isNotNull()
    single = (n == 1) & ~oneway
    value = F.struct(
        F.when(single, 0).otherwise(forward).cast("int").alias("forward"), F.when(single, 0).otherwise(backward).cast("int").alias("backward"),
        lane_turns(turn_f).alias("turn_forward"), lane_turns(turn_b).alias("turn_backward"), goal_f.alias("destination_forward"), goal_b.alias("destination_backward"),
    )
    is_usual = F.when(oneway, n == usual_oneway).otherwise(n == usual)
    return F.when(has["lanes"] & readable & (more | ~is_usual), value)


# ---- access


def access(tags: Column, usual: int = FOOT | BICYCLE | CAR) -> Column:
    """Bits of who may pass in which direction, starting from the type's usual ones.

    For each vehicle and direction the most special tag decides: its own direction, then the vehicle (not against a one-way street), then
    one-way streets and roundabouts, then the direction for everyone (forward before backward), then access=no. Other values of access change nothing.
    """
    oneway = tag(tags, "oneway")
    said = ~oneway.isin("no", "false", "0")
    back = F.coalesce(oneway == "-1", F.lit(False))
    ring = oneway.isNull() & is_in(tags, "junction", "roundabout")
    on = F.coalesce(said & (oneway != "-1"), F.lit(False)) | ring
    allowed = lambda key: tag(tags, key) != "no"  # noqa: E731  # null without the tag

    def bit(mask: int, direction: str, own: tuple[str, ...], walks: bool) -> Column:
        special = [allowed(f"{k}:{direction}") for k in own]
        against = back if direction == "forward" else on
        vehicle = [allowed(k) if walks else allowed(k) & ~against for k in own]
        # One-way rules don't concern walkers.
        street = [] if walks else [F.when(against, False), F.when(ring, True) if direction == "forward" else F.lit(None).cast("boolean")]
        everyone = allowed("access:forward") if direction == "forward" else F.when(~exists(tags, "access:forward"), allowed("access:backward"))
        whole = F.when(is_in(tags, "access", "no"), False)
        return F.when(F.coalesce(*special, *vehicle, *street, everyone, whole, F.lit(bool(usual & mask))), mask).otherwise(0)

    car = ("motorcar", "motor_vehicle")
    bits = [
        bit(FOOT_FORWARD, "forward", ("foot",), True), bit(FOOT_BACKWARD, "backward", ("foot",), True), bit(BICYCLE_FORWARD, "forward", ("bicycle",), False), bit(BICYCLE_BACKWARD, "backward", ("bicycle",), False),
        bit(CAR_FORWARD, "forward", car, False), bit(CAR_BACKWARD, "backward", car, False), F.when(on, ONEWAY_FORWARD).otherwise(0), F.when(back, ONEWAY_BACKWARD).otherwise(0),
    ]
    return reduce(lambda a, b: a + b, bits)


def may_pass(bits: Column, vehicle: str, direction: str) -> Column:
    """vehicle: foot, bicycle or car; direction: forward, backward or either."""
    f, b = {"foot": (FOOT_FORWARD, FOOT_BACKWARD), "bicycle": (BICYCLE_FORWARD, BICYCLE_BACKWARD), "car": (CAR_FORWARD, CAR_BACKWARD)}[vehicle]
    return bits.bitwiseAND(F.lit({"forward": f, "backward": b, "either": f | b}[direction])) != 0


# ---- other structures


def charging_sockets(tags: Column) -> Column:
    """Array of struct<type, capacity, output> from tags socket:TYPE and socket:TYPE:output."""
    keys = F.filter(F.map_keys(tags), lambda k: F.regexp_like(k, F.lit("^socket:[^:]+$")))
    return F.transform(F.array_sort(keys), lambda k: F.struct(F.substring_index(k, ":", -1).alias("type"), to_number(F.try_element_at(tags, k), "int").alias("capacity"), F.coalesce(F.try_element_at(tags, F.concat(k, F.lit(":output"))), F.lit("")).alias("output")))


def fee(tags: Column) -> Column:
    """struct<fee, condition>: yes, no, interval or unknown."""
    own, rule = tag(tags, "fee"), tag(tags, "fee:conditional")
    return F.when(own.isNotNull() | rule.isNotNull(), F.struct(F.when(own.isin("yes", "no", "interval"), own).otherwise("unknown").alias("fee"), F.coalesce(rule, F.lit("")).alias("condition")))


def from_to(tags: Column) -> Column:
    return F.when(exists(tags, "from") | exists(tags, "to"), F.struct(F.coalesce(tag(tags, "from"), F.lit("")).alias("from"), F.coalesce(tag(tags, "to"), F.lit("")).alias("to")))


def phone_numbers(tags: Column) -> Column:
    return split_list(F.coalesce(tag(tags, "phone"), tag(tags, "contact:phone")), ";")


def _plain(key: str, *more: str) -> Callable[[Column], Column]:
    return lambda tags: F.coalesce(*[tag(tags, k) for k in (key, *more)])


def _flag(key: str) -> Callable[[Column], Column]:
    return lambda tags: flag(tags, key)


#: Feature name -> Column factory. A user's own features join by adding to a copy of it.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "name": name, "name_alt": _plain("alt_name", "name_1"), "name_short": _plain("short_name"), "ref": _plain("ref"), "location": _plain("addr:street", "addr:place"),
    "address": _plain("addr:housenumber"), "postal_code": _plain("addr:postcode", "postal_code"), "is_in": _plain("is_in"), "website": _plain("website", "contact:website"),
    "phone": _plain("phone", "contact:phone"), "opening_hours": _plain("opening_hours"), "destination": _plain("destination"), "brand": _plain("brand"), "operator": _plain("operator"),
    "network": _plain("network"), "colour": _plain("colour", "color"), "access": access, "max_speed": max_speed, "width": width, "elevation": elevation, "layer": layer, "grade": grade,
    "admin_level": admin_level, "construction_year": construction_year, "milestone": milestone, "sideway": sideway, "lanes": lanes, "charging": charging_sockets, "fee": fee, "from_to": from_to,
    "max_stay": _plain("maxstay"), "bridge": _flag("bridge"), "tunnel": _flag("tunnel"), "embankment": _flag("embankment"), "building": _flag("building"),
    "roundabout": lambda tags: is_in(tags, "junction", "roundabout"), "clockwise": lambda tags: is_in(tags, "direction", "clockwise"),
    "access_restricted": lambda tags: is_in(tags, "access", "private", "destination", "delivery"),
}


def features(tags: Column, names: tuple[str, ...], catalogue: dict[str, Callable[[Column], Column]] = FEATURES) -> Column:
    """A struct of the named features."""
    return F.struct(*[catalogue[n](tags).alias(n) for n in names])


def filled_from(a: Column, b: Column, names: tuple[str, ...]) -> Column:
    """a's features, those it lacks from b."""
    return F.struct(*[F.coalesce(a[n], b[n]).alias(n) for n in names])
