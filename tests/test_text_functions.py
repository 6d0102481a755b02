import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import text as X


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, n", [("", 0), ("  a  b\tc\n", 3), ("one", 1)])
def test_word_count(spark, text, n):
    assert one(spark, X.word_count(F.col("t")), t=text) == n


def test_truncate_collapses_white_space(spark):
    assert one(spark, X.truncate_words(F.col("t"), 2), t=" a \n b c ") == "a b"


def test_usage_count_counts_overlapping_phrases(spark):
    # "use" is in useful and in use; "purpose" is in multi-purpose, which counts too.
    assert one(spark, X.usage_count(F.col("t")), t="Useful multi-purpose use") == 4


def test_ratios_are_zero_without_words(spark):
    row = spark.createDataFrame([("",)], "t string").select(
        X.avg_word_length(F.col("t")).alias("a"),
        X.usage_density(F.col("t")).alias("b"),
        X.flesch_reading_ease(F.col("t")).alias("c"),
    ).first()
    assert tuple(row) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(
    "html, text",
    [
        ("a<br />b", "a b"),
        ("a &lt;b&gt;c&lt;/b&gt;", "a c"),
        ("&#34;x&#34;", '"x"'),
        ("<script>no()</script><p>yes</p><!-- no --><style>no</style>", "yes"),
        (None, ""),
    ],
)
def test_html(html, text):
    assert X.strip_html(html) == text


@pytest.mark.parametrize(
    "completion, options",
    [
        ("Thought. Result: a; b.", ["a", "b"]),
        ("No usage options", []),
        ("a; No usage options; b", ["a"]),
        ("a;;b", ["a", "", "b"]),
    ],
)
def test_completion(spark, completion, options):
    assert one(spark, X.parse_completion(F.col("t")), t=completion) == options


def test_options_join_and_split(spark):
    assert one(spark, X.split_options(F.col("t")), t="a; b ; ") == ["a", "b"]
    assert one(spark, X.split_options(F.col("t")), t="No Usage Options") == []


@pytest.mark.parametrize(
    "reply, parts",
    [
        ("a; b; c; d", ["a", "b", "c"]),
        ("T: a\n\nH: b\n\nB: c", ["a", "b", "c"]),
        ("T: a\nH: b\nB: c", ["a", "b", "c"]),
        ("what", ["Error", "Error", "what"]),
    ],
)
def test_generated_review(spark, reply, parts):
    assert one(spark, X.parse_generated_review(F.col("t")), t=reply) == parts


def test_label_string(spark):
    row = spark.createDataFrame([("-",), ("a,b,1,c,d,0,e,f,1",)], "t string").select(X.decode_label_string(F.col("t")).alias("x")).collect()
    assert [tuple(r.x) for r in row] == [(0, 0, 0), (1, 1, 2)]


def test_log_probabilities(spark):
    df = spark.createDataFrame([(["a", "b", ",", "\n", "c"], [1.0, 2.0, 9.0, 9.0, 4.0])], "t array<string>, p array<double>")
    assert df.select(X.sum_logprobs(F.col("t"), F.col("p")).alias("x")).first().x == [3.0, 4.0]


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"),
        ("ponies", "poni"),
        ("relational", "relat"),
        ("hopping", "hop"),
        ("hoping", "hope"),
        ("agreed", "agre"),
        ("happy", "happi"),
        ("generalizations", "gener"),
        ("adjustment", "adjust"),
        ("controll", "control"),
    ],
)
def test_porter(word, stem):
    assert X.porter_stem(word) == stem


@given(st.text(max_size=30))
def test_stripped_html_has_single_spaces(text):
    assert "  " not in X.strip_html(text)
