from __future__ import annotations

from creditloom.llm.licences import NOTICES, licence_scan
from creditloom.llm.queries import ORACLE_SQL, QUERIES
from oracles.compare import compare, connect
from tests.conftest import SF


def scan(spark, files):
    rows = licence_scan(spark.createDataFrame(files, "path string, text string, digest string, file string, unit int")).collect()
    return {r.path: (r.licence, r.origin, r.from_path) for r in rows}, rows


def test_headers_files_and_inheritance(spark):
    extra = ("d", "f", 1)
    body = "some text about rivers\nand hills\n"
    files = [
        ("LICENSE", "Released under the MIT License.", *extra),
        ("a/b/COPYING", "Licensed under the Apache License, Version 2.0.", *extra),
        ("a/b/c/deep.py", body, *extra),
        ("a/own.py", "# Licensed under CC BY-NC 4.0.\n" + body * 30, *extra),
        ("a/plain.py", body, *extra),
        ("ab/plain.py", body, *extra),
        ("top.py", None, *extra),
        (None, body, *extra),
        ("b/mention.py", "They asked for permission to enter the old house by the river before the long winter came", *extra),
    ]
    found, rows = scan(spark, files + files[:1])
    assert len(rows) == 10
    assert found == {
        "LICENSE": ("MIT", "file", "LICENSE"),
        "a/b/COPYING": ("Apache-2.0", "file", "a/b/COPYING"),
        "a/b/c/deep.py": ("Apache-2.0", "inherited", "a/b/COPYING"),
        "a/own.py": ("CC-BY-NC-4.0", "header", "a/own.py"),
        "a/plain.py": ("MIT", "inherited", "LICENSE"),
        "ab/plain.py": ("MIT", "inherited", "LICENSE"),
        "top.py": ("MIT", "inherited", "LICENSE"),
        None: (None, None, None),
        "b/mention.py": ("MIT", "inherited", "LICENSE"),
    }


def test_every_notice_is_its_own_licence(spark):
    found, _ = scan(spark, [(f"p{i}/x", notice, "d", "f", 1) for i, (_, notice) in enumerate(NOTICES)])
    assert [found[f"p{i}/x"][0] for i in range(len(NOTICES))] == [licence for licence, _ in NOTICES]


def test_no_files(spark):
    assert scan(spark, [])[1] == []


def test_query_equals_its_statement(spark):
    assert compare(spark, connect(SF), SF, QUERIES["op3_licence_scan"], ORACLE_SQL["op3_licence_scan"]) == []
