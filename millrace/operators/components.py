"""What a page's breadcrumb says: its component, the component's words and class, the action's class, the topic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " › "

#: Beginnings of breadcrumb parts that name no component.
NOT_COMPONENTS = ["remove", "replace", "install", "removal", "installation", "reassembly", "disassembly", "overhaul", "adjustment", "adjust", "inspection", "inspect", "diagnosis", "diagnostic", "testing", "test", "procedure", "components", "precaution", "description", "bleeding", "bleed", "balance", "alignment", "rotation", "refinish", "calibration", "initialization", "registration", "reset", "measurement", "check", "service information", "parts location", "illustration", "wiring diagram", "system diagram", "data list", "maintenance overview", "operation check"]
#: Words that tell nothing about a part.
GENERIC = ["assembly", "assy", "sub", "system", "systems", "unit", "and", "the", "for", "with", "complete", "type", "side", "set", "kit", "component", "components"]
#: Words that make parts of otherwise like names different ones.
OPPOSITES = [("front", "rear"), ("front", "back"), ("left", "right"), ("lh", "rh"), ("upper", "lower"), ("inner", "outer"), ("no1", "no2"), ("no2", "no3"), ("no1", "no3")]
#: Words that name the kind of a part.
PART_KINDS = ["sensor", "switch", "relay", "valve", "cable", "hose", "gasket", "seal", "bearing", "pump", "motor", "battery", "shaft", "belt", "filter", "module", "actuator", "solenoid", "radiator", "condenser", "compressor", "pulley", "bracket", "cover", "lamp", "light", "mirror", "panel", "spring", "damper", "absorber", "rotor", "disc", "disk", "pad", "caliper", "clutch", "injector", "plug", "coil", "amplifier", "antenna", "camera", "regulator", "thermostat", "alternator", "starter", "muffler", "manifold", "tank", "reservoir"]
#: Classes of actions with the phrases that name them; the first class with a phrase in the text counts.
ACTIONS = {
    "replace": ["remove & replace", "remove and replace", "removal", "install", "installation", "replacement", "replace", "r & r", "r&r"],
    "overhaul": ["overhaul", "disassembly", "reassembly", "assembly"],
    "refinish": ["refinish", "resurface", "machining"],
    "bleed": ["bleeding", "bleed"],
    "fluid": ["drain & refill", "drain and refill", "flush", "refill", "recover", "recharge", "evacuate", "charge"],
    "inspect": ["on-vehicle inspection", "inspection", "inspect", "testing", "test", "measurement", "measure", "check"],
    "adjust": ["adjustment", "adjust", "calibrat", "initializ", "registration", "reset"],
    "diagnose": ["diagnosis", "diagnostic", "trouble", "dtc"],
    "balance": ["balance", "alignment", "rotation", "rotate"],
}
#: Classes that go together besides each with itself.
FITTING = [("replace", "overhaul"), ("replace", "refinish"), ("fluid", "bleed"), ("inspect", "diagnose")]
#: Last parts of a breadcrumb that tell a page's kind, and first parts that are no system.
PAGE_KINDS = ["procedure", "description", "wiring diagram", "illustration", "caution / notice / hint", "components", "fail-safe", "equipment"]
NO_SYSTEMS = ["external pages", ""]
#: Actions that a question can be asked about.
ASKED = ["removal", "installation", "replacement", "remove & replace", "inspection", "on-vehicle inspection", "disassembly", "reassembly", "adjustment", "parts location", "precaution", "system diagram", "problem symptoms table", "terminals of ecu", "operation check", "diagnosis system", "data list / active test"]


def _parts(crumb: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(crumb, F.lit("")), SEPARATOR), lambda x: F.trim(x)), lambda x: x != "")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def _component_at(parts: Column) -> Column:
    """Place (from 1) of the last part that is a component's name, 0 if none is."""
    names = F.transform(parts, lambda x: ~F.lower(x).rlike("^(" + "|".join(NOT_COMPONENTS) + ")"))
    return F.array_max(F.concat(F.array(F.lit(0)), F.transform(names, lambda ok, i: F.when(ok, i + 1).otherwise(0))))


def component(crumb: Column) -> Column:
    """The component's name in a breadcrumb, empty if there is none."""
    parts = _parts(crumb)
    return F.coalesce(F.get(parts, _component_at(parts) - 1), F.lit(""))


def component_words(crumb: Column, with_parent: bool = False) -> Column:
    """Words of the component's name of more than two letters that are not generic, sorted; with_parent adds those of the part above it."""
    parts = _parts(crumb)
    at = _component_at(parts)
    name = F.coalesce(F.get(parts, at - 1), F.lit(""))
    if with_parent:
        name = F.concat_ws(" ", name, F.when(at > 1, F.get(parts, at - 2)))
    return F.array_sort(F.array_distinct(F.filter(_words(name), lambda w: (F.length(w) > 2) & ~w.isin(GENERIC))))


def part_kind(crumb: Column) -> Column:
    """The last word of the component's name that names a kind of part; null if none does."""
    kinds = F.filter(_words(component(crumb)), lambda w: w.isin(PART_KINDS))
    return F.when(F.size(kinds) > 0, F.get(kinds, F.size(kinds) - 1))


def same_component(a: Column, b: Column) -> Column:
    """Whether two breadcrumbs name one component (the first with the part above it); if either names none, they do not.

    Names with opposite directions differ. One name's words within the other's agree; else they need two in common, and
    kinds that do not contradict.
    """
    wa, wb = component_words(a, with_parent=True), component_words(b)
    # Of a pair of opposites each name has some, and not the same.
    against = [F.arrays_overlap(wa, pair) & F.arrays_overlap(wb, pair) & (F.array_intersect(pair, wa) != F.array_intersect(pair, wb)) for pair in (F.array(*map(F.lit, p)) for p in OPPOSITES)]
    within = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    kinds = F.coalesce(part_kind(a) == part_kind(b), F.lit(True))
    return (F.size(wa) > 0) & (F.size(wb) > 0) & ~reduce(lambda x, y: x | y, against) & (within | ((F.size(F.array_intersect(wa, wb)) >= 2) & kinds))


def action_class(text: Column) -> Column:
    """The class of the action that a text names; null if none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(reduce(lambda x, y: x | y, [low.contains(p) for p in phrases]), F.lit(name)) for name, phrases in ACTIONS.items()])


def actions_fit(a: Column, b: Column) -> Column:
    """Whether two classes go together; unknown ones do not."""
    pairs = [(a == x) & (b == y) | (a == y) & (b == x) for x, y in FITTING]
    return F.coalesce((a == b) | reduce(lambda x, y: x | y, pairs), F.lit(False))


def plain_name(text: Column) -> Column:
    """Lower case without bracketed and parenthesised parts; all but letters, digits, `_` and white space become single spaces."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, r"\[[^\]]*\]", " ")), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s/&-]", " "), r"\s+", " "))


def topic(crumb: Column) -> Column:
    """(system, component, action) of a breadcrumb; null if it has no clean topic.

    Last parts that tell the page's kind go; then the last part is the action, which must be one that can be asked about,
    the one before it the component, of 3 letters or more and at most 8 words and no action itself, the first the system.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(crumb, F.lit("")), SEPARATOR), lambda x: F.trim(F.regexp_replace(x, r"\[[^\]]*\]", " "))), lambda x: x != "")
    told = F.transform(parts, lambda x, i: F.when(F.lower(x).isin(PAGE_KINDS), 0).otherwise(i + 1))
    kept = F.slice(parts, 1, F.coalesce(F.array_max(told), F.lit(0)))
    n = F.size(kept)
    system, name, action = F.get(kept, F.lit(0)), F.get(kept, n - 2), plain_name(F.get(kept, n - 1))
    short = plain_name(name)
    fit = (n >= 3) & ~F.lower(system).isin(NO_SYSTEMS) & action.isin(ASKED) & (F.length(short) >= 3) & (F.size(F.split(short, " ")) <= 8) & ~short.isin(ASKED)
    return F.when(fit, F.struct(system.alias("system"), name.alias("component"), action.alias("action")))
