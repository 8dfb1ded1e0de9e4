"""Scalar functions on tag texts and result texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col


def try_number(text, kind: str = "double") -> Column:
    return col(text).try_cast(kind)


def is_numeric(text) -> Column:
    return F.trim(col(text)).rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$")


def mph_to_kmh(text) -> Column:
    """``30 mph`` as km/h text, other texts as they are."""
    t = col(text)
    return F.when(t.rlike("^[0-9]+ mph$"), F.floor(F.regexp_extract(t, "^([0-9]+)", 1).cast("double") * 1.61 + 0.5).cast("int").cast("string")).otherwise(t)


#: Units in the order they are looked for, with the factor to the base unit; fixed values.
UNITS = (
    ("ft", 0.3048),
    ("feet", 0.3048),
    ("inch", 0.0254),
    ("in", 0.0254),
    ("fathom", 1.8288),
    ("cm", 0.01),
    ("meter", 1.0),
    ("mph", 1.609344),
    ("knot", 1.852),
    ("kmh", 1.0),
    ("km/h", 1.0),
    ("m", 1.0),
    ("st", 0.907185),
    ("kg", 0.001),
    ("lbs", 0.00045359237),
    ("t", 1.0),
)


def to_base_unit(text) -> Column:
    """Numeric value of a tag text with a unit: feet and inches, lengths, speeds and weights; of a range the first; null if there is none."""
    t = F.lower(F.replace(F.trim(col(text)), F.lit(","), F.lit(".")))
    number = F.regexp_extract(t, r"^([0-9]+[.]?[0-9]*)", 1).try_cast("double")
    feet = F.regexp_extract(t, r"^([0-9]+)'", 1).try_cast("double")
    inches = F.coalesce(F.regexp_extract(t, r"'\s*([0-9]+[.]?[0-9]*)\"", 1).try_cast("double"), F.lit(0.0))
    value = F.when(feet.isNotNull(), feet * 0.3048 + inches * 0.0254)
    for unit, factor in UNITS:
        value = value.when(F.contains(t, F.lit(unit)), number * factor)
    return value.otherwise(number)


def normalised(tags: Column) -> Column:
    """Access ``unknown`` renamed, and surface sub-values as tags of their own unless present."""
    renamed = F.transform_values(tags, lambda k, v: F.when((k == "access") & (v == "unknown"), "value_unknown").otherwise(v))
    part = F.regexp_extract(tags["surface"], "^concrete:(.+)$", 1)
    return F.when((F.coalesce(part, F.lit("")) != "") & ~F.coalesce(F.array_contains(F.map_keys(tags), "concrete"), F.lit(False)), F.map_concat(renamed, F.create_map(F.lit("concrete"), part))).otherwise(renamed)


def description(tags: Column) -> Column:
    """``k=v k=v`` in the order of the keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


def ladder(value, *steps: tuple[float, str], last: str, below: bool = True) -> Column:
    """The class of the first step that the value is under (or over, with ``below=False``); nulls fall to the last."""
    v, out = col(value), None
    for limit, name in steps:
        test = v < limit if below else v > limit
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(last)


#: Upper limits of the classes 1 to 5; the last class is 6.  Fixed values.
CLASSES = {
    "noise": (0.06, 0.13, 0.26, 0.45, 0.85),
    "river": (0.22, 0.35, 0.5, 0.75, 0.98),
    "forest": (0.32, 0.5, 0.7, 0.92, 5.0),
}


def environment_class(kind: str, value) -> Column:
    return ladder(value, *[(x, str(i + 1)) for i, x in enumerate(CLASSES[kind])], last="6")


def duration(seconds) -> Column:
    """``1h 2m 3s``, without the parts that are zero; the empty text for none."""
    s = F.floor(col(seconds) + 0.5).cast("bigint")
    parts = ((F.floor(s / 3600), "h "), (F.floor(F.pmod(s, F.lit(3600)) / 60), "m "), (F.pmod(s, F.lit(60)), "s"))
    return F.concat(*[F.when(n != 0, F.concat(n.cast("bigint").cast("string"), F.lit(unit))).otherwise("") for n, unit in parts])


def track_name(text) -> Column:
    return F.regexp_replace(col(text), r"[^a-zA-Z0-9 ._\-]+", "")


def xml_escaped(text) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def json_escaped(text) -> Column:
    out = col(text)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("'", "\\'"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def incline(text, reverse=None) -> Column:
    """The number of an incline tag up to its sign ``%`` or ``\u00b0``, turned round against the way's direction; 0 where there is none."""
    first = F.split(F.coalesce(col(text), F.lit("")), "[ %\u00b0]", 2)[0]
    number = F.coalesce(F.trim(first).try_cast("double"), F.lit(0.0))
    return number if reverse is None else F.when(col(reverse), -number).otherwise(number)


#: Texts of the trigger bits of a suspect place, from the lowest bit; fixed values.
TRIGGERS = ("dead-end", "dead-start", "node-block", "bad-access", "unkown-access", "sharp-exit", "sharp-entry", "sharp-link", "bad-tr")


def trigger_text(bits) -> Column:
    b = col(bits)
    return F.array_join(F.filter(F.array(*[F.when(b.bitwiseAND(F.lit(1 << i)) != 0, F.lit(t)) for i, t in enumerate(TRIGGERS)]), lambda x: x.isNotNull()), ",")


def suspect_level(priority) -> Column:
    """The even level of a priority, and its road class."""
    return (F.floor((col(priority) + 1) / 2) * 2).cast("int")


#: Levels of road classes; fixed values.
LEVELS = {30: "motorway", 28: "trunk", 26: "primary", 24: "secondary", 22: "tertiary"}


def level_name(level) -> Column:
    out = None
    for k, name in LEVELS.items():
        out = F.when(col(level) == k, name) if out is None else out.when(col(level) == k, name)
    return out.otherwise("none")


def age_text(minutes) -> Column:
    m = col(minutes)
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" minutes"))).when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit(" hours"))).otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit(" days")))
