import math
import re

import duckdb
import pytest

from kalkula.llm.licenses import OP1_SQL, PHRASES, TEMPLATES, THRESHOLD, op1_license_setjoin
from tests.llm.fixtures import ROWS, SCHEMA, write

MORE = [
    (50, "Released UNDER the MIT-License, under the mit license under the mit license.", "en", "a", 1, "x"),
    (51, "cc by nc cc BY-NC 4.0\nApache License, Version 2.0\nall\nrights\nreserved", "en", "a", 1, "x"),
    (52, "Redistribution and use in source and binary forms, with or without any change are allowed", "en", "a", 1, "x"),
    (53, "Redistribution and use in source and binary forms, with or without modification", "en", "a", 1, "x"),
    (54, "cc by nK cc by nK; mİt license\nGNU Lesser General Public License", "en", "a", 1, "x"),
    (55, "public license general gnu", "en", "a", 1, "x"),
    *((70 + i, f"{before}\n{notice}\n and more words after it", "en", "a", 1, "x") for i, (before, notice) in enumerate((b, n) for b in ("", "seven words of the text stand before") for n in (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the",
        "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided",
    ))),
]


def brute(row):
    lower = lambda s: "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in s)
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))
    text = row[1] or ""
    ws = split(text)
    at = sorted((i, label) for label, p in PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    more, share = set(), 0.0
    for label, t in TEMPLATES:
        own, m = set(t.split()), len(t.split())
        for start in range(0, len(ws), m):
            have = set(ws[start : start + 2 * m])
            if len(own & have) >= math.ceil(THRESHOLD * len(own) - 1e-9):
                more.add(label)
                share = max(share, len(own & have) / len(own))
    base = {x[1] for x in at}
    return row[0], len(ws), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else pytest.approx(share)


def test_awkward_rows(spark, tmp_path):
    rows = ROWS + MORE
    got = sorted((tuple(r) for r in op1_license_setjoin(spark, write(spark, tmp_path, rows)).collect()), key=str)
    assert len(got) == len(rows)
    by = {}
    for g in got:
        by.setdefault(g[0], []).append(g)
    for r in rows:
        assert brute(r) in by[r[0]], r[0]


def test_wrapped_notices(spark, tmp_path):
    got = {r["doc_id"]: r["labels"] for r in op1_license_setjoin(spark, write(spark, tmp_path, MORE)).collect()}
    assert [got[70 + i] for i in range(8)] == ["mit", "apache-2", "bsd", "isc"] * 2


def test_many_templates(spark, tmp_path):
    """Templates are data of the index, not expressions each."""
    from kalkula.llm.licenses import license_scan

    templates = tuple((f"label{i}", " ".join(f"w{i}x{j}" for j in range(12))) for i in range(300))
    rows = [(i, "some words first " + " ".join(t.split()[:10]) + " and others", "en", "a", 1, "x") for i, (_, t) in enumerate(templates)]
    found = license_scan(spark.createDataFrame(rows, SCHEMA), templates=templates).collect()
    assert {r["id"]: [(c["label"], c["share"]) for c in r["contained"]] for r in found} == {i: [(f"label{i}", 10 / 12)] for i in range(300)}


def test_same_as_sql(spark):
    at = "/root/testdata/sf0.01/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}'")
    cursor = db.execute(OP1_SQL)
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    got = sorted(tuple(r) for r in op1_license_setjoin(spark, "/root/testdata/sf0.01").select(*names).collect())
    assert got == want
    assert sum(r[2] > 0 for r in got) > 5


def test_plan_is_native(spark):
    plan = op1_license_setjoin(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark, tmp_path):
    assert op1_license_setjoin(spark, write(spark, tmp_path, [], SCHEMA)).count() == 0
