"""Registered queries against their SQL twins, over whole tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

# Quick ones by default; EVENTLOOM_ALL=1 runs every query.
QUICK = ("governance_codes", "event_measures", "required_fields", "redact_names", "redact_paths", "typed_projection",
         "dedupe_window", "delivery_policy", "payload_explode", "otlp_flatten", "retain_size", "archive_layout")
NAMES = sorted(entry.queries()) if os.environ.get("EVENTLOOM_ALL") else QUICK


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    good, note = compare(spark, tables, SF_DIR, name)
    assert good, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
