"""Native operators run no Python, and none plans a cross or nested-loop join."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry

NATIVE = {"op2", "op3", "op6", "op7", "op10"}


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if re.match(r"op\d+_", n)))
def test_plan(spark, small, name):
    out = io.StringIO()
    with redirect_stdout(out):
        entry.queries()[name](spark, small).explain("formatted")
    text = out.getvalue()
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    if name.split("_")[0] in NATIVE:
        assert not re.search("Python|Pandas|Arrow", text)


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
