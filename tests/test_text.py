from pyspark.sql import functions as F

from lexiframe.functions.text import non_blank, non_empty, normalize, pretokenize, strip_heading


def _one(spark, col_fn, values, schema="t string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col_fn(F.col("t"))).collect()]


def test_heading_cases(spark):
    got = _one(spark, strip_heading, [" = Title = \n", " = = Section = = \n", "p\n = A = \n = B = \n", "no head"])
    assert got == ["Title \n", "Section = \n", "p\nA \n = B = \n", "no head"]


def test_blank_and_empty(spark):
    vals = ["", " \n", "a", "  "]
    assert _one(spark, non_blank, vals) == [False, False, True, False]
    assert _one(spark, non_empty, vals) == [False, True, True, True]


def test_accents_and_case(spark):
    assert _one(spark, normalize, ["Été ÉCOLE", "ASCII Only", "Straße Ñandú"]) == \
        ["ete ecole", "ascii only", "straße nandu"]


def test_pretokenize(spark):
    got = _one(spark, pretokenize, ["hello, world!! foo_bar 42x", "  ", "a.[b"])
    assert got == [["hello", ",", "world", "!!", "foo_bar", "42x"], [], ["a", ".[", "b"]]


def test_normalize_matches_python(spark):
    import unicodedata

    import regex
    from tokenizers import normalizers

    vals = ["Ça Été", "ÀÉÎÕÜ àéîõü", "İstanbul", "ΣΊΣΥΦΟΣ", "mixed ASCII and ñ", "\u039F\u0394\u039F\u03A3 I\u0131 \u0130\u015E"]
    one_by_one = ["".join(c.lower() for c in unicodedata.normalize("NFD", v)) for v in vals]
    want = [regex.sub(r"\p{M}+", "", v) for v in one_by_one]
    assert _one(spark, normalize, vals) == want
    library = normalizers.Sequence([normalizers.NFD(), normalizers.Lowercase(), normalizers.StripAccents()])
    assert want == [library.normalize_str(v) for v in vals]
