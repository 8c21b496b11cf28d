import pytest

from rollweave.functions.segmentation import fold, segment
from rollweave.operators.packed import dictionary, explode_packed

KNOWN = frozenset(map(fold, ["CI/CD", "PL/SQL", "Java", "Python", "Salt, pepper", "AC; DC"]))


@pytest.mark.parametrize(
    ("cell", "want"),
    [
        (None, []),
        ("", []),
        ("  \t ", []),
        ("Java", ["Java"]),
        ("a, ,b,,", ["a", "b"]),
        ("a ;b;c", ["a", "b", "c"]),
        ("CI/CD / PL/SQL / x", ["CI/CD", "PL/SQL", "x"]),
        ("gnu/linux | SAP R/3", ["gnu/linux", "SAP R/3"]),
        ('"wine, tasting" ,"b"', ["wine, tasting", "b"]),
        ("'Excel; macros | VBA';x", ["Excel; macros | VBA", "x"]),
        ('"the ""R"" language"|x', ['the "R" language', "x"]),
        ('["a, b", "c \\"d\\"", null, ""]', ["a, b", 'c "d"']),
        ("[a, b]", ["a", "b"]),
        ("x • y\nz\tw · v", ["x", "y", "z", "w", "v"]),
        ("CV (vision, sound), b", ["CV (vision, sound)", "b"]),
        ("a, salt, pepper, b", ["a", "salt, pepper", "b"]),
        ("ac; dc; b", ["ac; dc", "b"]),
        ("İ, ac; dc; salt, pepper", ["İ", "ac; dc", "salt, pepper"]),
        ("Java/ Python", ["Java", "Python"]),
        ("Java/ else", ["Java/ else"]),
        ("it's, o'clock", ["it's", "o'clock"]),
        ('5" disk, b', ['5" disk', "b"]),
        ('"open, b', ['"open', "b"]),
        ("a, a", ["a", "a"]),
    ],
)
def test_segment(cell, want):
    assert segment(cell, KNOWN) == want


def test_segment_is_linear_on_long_cells():
    assert len(segment("x/ " * 50_000 + ", b", KNOWN)) == 2
    assert len(segment("a,(" * 20_000, KNOWN)) == 20_001


def test_explode_keeps_clashing_columns_and_positions(spark):
    df = spark.createDataFrame([(1, "a;b", "p"), (2, None, "q"), (3, " ", "r"), (3, "c", "r")], "id bigint, cell string, pos string")
    got = explode_packed(df, "cell", [], ["id"]).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "a"), (1, 2, "b"), (3, 1, "c")]
    assert explode_packed(df.limit(0), "cell", [], ["id"]).count() == 0


def test_dictionary_is_bounded(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "v string")
    assert dictionary(df, "v") == ["a", "b"]
    with pytest.raises(ValueError, match="more than 2"):
        dictionary(df, "v", most_chars=2)
