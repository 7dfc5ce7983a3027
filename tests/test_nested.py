import json

from ledgerloom.operators.nested import analyse, child_rows, plan_tables, shred, unreadable


def test_child_rows(spark):
    a = {"invoice_number": "1", "line_items": [{"description": "x", "cells": [{"column": "hsnCode", "candidates": [{"text": "a"}, None, {"text": "b"}]}]}, None, {"description": "y"}], "field_provenance": {"grandTotal": {"candidates": {"text": "z"}}, "vendor_name": {"candidates": None}}}
    b = {"data": {"invoice": {"items": json.dumps([{"description": "q"}]), "columns": [{"key": "k"}]}}}
    c = {"items": {"description": "lone"}}
    rows = [(1, json.dumps(a)), (1, json.dumps(a)), (2, json.dumps(b)), (3, json.dumps(c)), (4, json.dumps(a)[:40]), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "payload_id bigint, payload string")
    got = sorted((r.payload_id, r.child_kind, r.parent_key, r.pos) for r in child_rows(df).collect())
    assert got == sorted([
        (1, "line_items", "invoice", 0), (1, "line_items", "invoice", 2), (1, "candidates", "line_items[0].hsn_code", 0), (1, "candidates", "line_items[0].hsn_code", 2),
        (1, "candidates", "grand_total", 0), (2, "line_items", "invoice", 0), (2, "columns", "invoice", 0), (3, "line_items", "invoice", 0),
    ])
    assert sorted(r[0] for r in unreadable(df, "payload_id", "payload").collect()) == [4, 5, 6]
    assert child_rows(df.limit(0)).count() == 0


def test_round_trip_of_flat_rows(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": {"b": 1}, "xs": [{"c": 2}, {"c": 3, "ys": [{"d": 4}]}]}))], "id bigint, p string")
    rows = {r.row_key: json.loads(r.attributes) for r in shred(df, "id", "p", analyse(df, "p")).collect()}
    assert rows == {"invoice": {"a.b": 1}, "xs[0]": {"c": 2}, "xs[1]": {"c": 3}, "xs[1].ys[0]": {"d": 4}}


def test_recursive_element_has_a_table():
    assert "node" in plan_tables([("invoice", "node", "object", 1), ("node", "node", "object", 1)]).tables
