import pytest
from pyspark.sql import functions as F

from cellgrid.operators.packed import explode_packed, first_delivery, packed_values

CASES = [
    (None, []), ("", []), ("  ", []), ("[]", []), ("[ ]", []), ("NaN", []), ("none", []), ("()", []), ("{}", []),
    ("Chart", ["Chart"]), ("['Chart', 'Table']", ["Chart", "Table"]), ('["Chart","Table"]', ["Chart", "Table"]),
    ("['Chart' 'Table']", ["Chart", "Table"]), ("('Map',)", ["Map"]), ("{'Chart'}", ["Chart"]),
    ("[Table, Table]", ["Table", "Table"]), ('"[\\"Chart\\", \\"Map\\"]"', ["Chart", "Map"]),
    ('"[\\"Figure \\\\\\"inset\\\\\\"\\"]"', ['Figure "inset"']),
    ("Pure-text (Plain-text), Map (north, south)", ["Pure-text (Plain-text)", "Map (north, south)"]),
    ('"Author\'s note",Table', ["Author's note", "Table"]), ('"Figure ""inset""", Map', ['Figure "inset"', "Map"]),
    ("“Photo”, “Pure-text (Plain-text)”", ["Photo", "Pure-text (Plain-text)"]), ("Text、Chart，Map", ["Text", "Chart", "Map"]),
    (", ,Figure|;", ["Figure"]), ("A / B / C", ["A", "B", "C"]), ("A/B", ["A/B"]), ('"Header | footer"|X', ["Header | footer", "X"]),
    ("A\r\nB\n\nC\tD", ["A", "B", "C", "D"]), ("a0b, c", ["a0b", "c"]), ("['', 'x']", ["x"]),
    ("a (x, b (c, (d, (e, f)))), g", ["a (x, b (c, (d, (e, f))))", "g"]), ("[a, [b, c]]", ["a", "b", "c"]), ("[[a], [[b, c]], 'd, e']", ["a", "b", "c", "d, e"]),
    ("((((((x, y)))))), z (1), (((((", ["((((((x, y))))))", "z (1)", "((((("]), ("[Table [1], Figure]", ["Table [1]", "Figure"]), ("'q (((( (a, b', c", ["q (((( (a, b", "c"]),
    ("Author's note, Bob's", ["Author's note", "Bob's"]), ('["unclosed, x', ['"unclosed', "x"]),
]


@pytest.mark.parametrize("n", [1])
def test_cases(spark, n):
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(CASES)], "i int, f string")
    got = {r.i: r.v for r in df.select("i", packed_values(F.col("f")).alias("v")).collect()}
    for i, (field, want) in enumerate(CASES):
        assert got[i] == want, (field, got[i], want)


def test_very_long_field(spark):
    text = ",".join(f"'v{k}'" for k in range(20000))
    df = spark.createDataFrame([(text,)], "f string")
    v = df.select(packed_values(F.col("f")).alias("v")).first().v
    assert len(v) == 20000 and v[19999] == "v19999"


def test_positions_clashing_names_and_empty(spark):
    df = spark.createDataFrame([("q", "A, ,B,A", 7)], "id string, f string, pos int")
    assert [tuple(r) for r in explode_packed(df, "f", "v").collect()] == [("q", 1, "A"), ("q", 2, "B"), ("q", 3, "A")]
    assert explode_packed(df.limit(0), "f", "v").count() == 0


def test_first_delivery(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 1, "y"), (None, 1, "z")], "id string, t int, f string")
    assert sorted(first_delivery(df, "id", "t", ["id", "f"]).collect()) == [("a", None), ("b", "y")]
