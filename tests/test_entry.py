from __future__ import annotations

import importlib
import importlib.util
import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_operators(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, package=None: None if name.startswith("tessella.llm") else real(name, package))
    bare = importlib.reload(__spark_entry__)
    assert bare.llm is None and "p7_found" in bare.queries() and "p1_found" not in bare.queries()
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")
def test_the_flagship_answers_every_question(spark):
    assert __spark_entry__.queries()["retrieval_pipeline"](spark, SMALL).select("query_id").distinct().count() == 240
