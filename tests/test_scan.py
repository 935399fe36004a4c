"""The scan against each pattern run alone."""

import random
import re

from symloom.operators import scan

PARTS = ['x = "SELECT a" + b', "+ 'DELETE", "q.format(1) UPDATE", 'f"SELECT {a}', "exec (", "eval(", "os.system\\t(", "popen(", "subprocess.run(", "../..", "..\\\\", "pwd='a'", 'api-key = "b"', "token = 'c' token='d'", "secret=\"é\"", "execute(", "raw  (", "query(", "é", "plain words", "+", '"', "\\u2028", "\\r", "password = ''", "api key"]


def test_matches_and_places_equal_pattern_by_pattern(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(PARTS) + rng.choice(["", " ", "\n", "😀"]) for _ in range(rng.randrange(0, 12)))) for i in range(300)] + [(None, "exec("), (900, None), (901, ""), (1, "exec("), (1, "exec(")]
    got = sorted((str(r["id"]), r["kind"], r["severity"], r["place"], r["match"]) for r in scan.scan(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect())
    want = sorted((str(i), p.kind, p.severity, m.start(), m[0]) for i, t in rows for p in scan.PATTERNS for m in re.finditer(p.expression, t or "", re.A))
    assert got == want and len(want) > 300


def test_every_pattern_needs_one_of_its_literals():
    for p in scan.PATTERNS:
        for part in PARTS:
            for m in re.finditer(p.expression, part):
                assert any(x in m[0] for x in p.literals)


def test_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "eval(", "x", "y")], "id long, html string, text string, has string")
    assert [tuple(r) for r in scan.scan(df, "id", "html").collect()] == [(1, "command", "critical", 0, "eval(")]
    assert scan.scan(df.limit(0), "id", "html").count() == 0
