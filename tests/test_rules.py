"""Nested secrets and copies that catch up."""

import json

from millrace.functions.redaction import REDACTED, without_secrets
from millrace.sources.files import caught_up


def test_secrets():
    assert without_secrets({"a": {"PassWord": {"x": 1}}, "b": ["cookie: yum yum", 5, None, "short"]}) == {"a": {"PassWord": REDACTED}, "b": [f"cookie: {REDACTED} yum", 5, None, "short"]}
    assert without_secrets("GET /x?token=abc&y=1 Bearer abcdefgh.ijk") == f"GET /x?token={REDACTED}&y=1 Bearer {REDACTED}"
    assert json.dumps(without_secrets([[[[[[["x"], {"k": 1}]]]]]])).count("max-depth") == 2


def test_caught_up(spark, tmp_path):
    path = f"file://{tmp_path}/copy"
    first = caught_up(spark.range(10), path, "id").first()
    assert (first.mark, first.copied, first.same) == (None, 10, True)
    again = caught_up(spark.range(10), path, "id").first()
    assert (again.mark, again.copied, again.same) == (9, 0, True)
    more = caught_up(spark.range(25), path, "id").first()
    assert (more.mark, more.copied, more.rows_copy, more.max_copy, more.same) == (9, 15, 25, 24, True)
    late = caught_up(spark.range(-3, 25), path, "id").first()
    assert (late.copied, late.same) == (0, False)
