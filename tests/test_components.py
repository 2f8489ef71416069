"""Components, actions and topics of breadcrumbs, by cases."""

from pyspark.sql import functions as F

from millrace.operators import components as C

CRUMBS = {
    "Brakes › Front Brake Caliper › Removal › Procedure": ("Front Brake Caliper", ["brake", "caliper", "front"], "caliper"),
    "Body › Battery Voltage Sensor Assembly": ("Battery Voltage Sensor Assembly", ["battery", "sensor", "voltage"], "sensor"),
    "Removal › Installation": ("", [], None),
    None: ("", [], None),
    " › Axle Shafts - Front › Axle Shaft Assy › Replacement": ("Axle Shaft Assy", ["axle", "shaft"], "shaft"),
}


def test_components(spark):
    rows = spark.createDataFrame([(k,) for k in CRUMBS], "c string")
    got = {r.c: (r.n, r.w, r.k) for r in rows.select("c", C.component(F.col("c")).alias("n"), C.component_words(F.col("c")).alias("w"), C.part_kind(F.col("c")).alias("k")).collect()}
    assert got == CRUMBS


def test_same_component(spark):
    cases = [
        ("x › Front › Brake Pad › Removal", "y › Brake Pad", True),
        ("x › Front Axle › Axle Shaft", "y › Rear Axle Shaft", False),
        ("x › Front Axle › Axle Shaft", "y › Front Axle Shaft", True),
        ("High Voltage Battery", "Battery Voltage Sensor", False),
        ("Engine Oil Pump Seal", "Oil Pump Gasket Seal", True),
        ("Oil Pump", "Fuel Tank", False),
        ("Removal", "Oil Pump", False),
        (None, "Oil Pump", False),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: r.s for r in rows.select("i", C.same_component(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got == {i: s for i, (_, _, s) in enumerate(cases)}


def test_actions_and_topics(spark):
    texts = {"Remove & Replace": "replace", "Brake Bleeding": "bleed", "DTC list": "diagnose", "Overview": None, None: None, "Wheel Alignment": "balance"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.c for r in rows.select("t", C.action_class(F.col("t")).alias("c")).collect()} == texts
    pairs = spark.createDataFrame([("replace", "refinish", True), ("bleed", "fluid", True), ("inspect", "adjust", False), ("adjust", "adjust", True), (None, "adjust", False), (None, None, False)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in pairs.select("want", C.actions_fit(F.col("a"), F.col("b")).alias("got")).collect())
    crumbs = {
        "Brakes › Pad [01/2020 - ] › Removal › Procedure › Description": ("Brakes", "Pad", "removal"),
        "Brakes › Pad › Painting": None,
        "External Pages › Pad › Removal": None,
        "Brakes › Removal › Removal": None,
        "Pad › Removal": None,
        "Procedure": None,
        None: None,
    }
    rows = spark.createDataFrame([(c,) for c in crumbs], "c string")
    got = {r.c: tuple(r.t) if r.t else None for r in rows.select("c", C.topic(F.col("c")).alias("t")).collect()}
    assert got == crumbs
