"""Spark expressions of the Python string rules agree with Python itself."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatewarden.functions import text as T

# Characters that matter: Python whitespace, line breaks, quotes, '=', '#'.
ALPHABET = st.sampled_from(
    list("aZ09=#-_ '\"") + ["\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0",
                            " ", " ", "　", " ", "é", "→"]
)
TEXTS = st.text(alphabet=ALPHABET, max_size=30)


def _one(spark, values, expr_fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = df.select("i", expr_fn(F.col("s")).alias("o")).collect()
    return [r.o for r in sorted(got, key=lambda r: r.i)]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_py_strip_matches_python(spark, values):
    assert _one(spark, values, T.py_strip) == [v.strip() for v in values]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_split_lines_matches_python(spark, values):
    got = _one(spark, values, T.split_lines)
    for g, v in zip(got, values):
        # splitlines() drops the trailing empty piece; blank lines are skipped by callers anyway
        assert [x for x in g if x] == [x for x in v.splitlines() if x]
        assert g[: len(v.splitlines())] == v.splitlines()


def test_slug_values(spark):
    cases = {"My LLM": "my-llm", "--a--": "a", "!!!": "custom", "": "custom", "Ünï": "n", "a.b/c:1": "a-b-c-1", "-": "custom", "x\ty": "x-y"}
    assert _one(spark, list(cases), T.slug) == list(cases.values())


def test_unquote_once(spark):
    cases = {'"q"': "q", "'q'": "q", '"': '"', "'x\"": "'x\"", '""': "", "a": "a", '"a"b"': 'a"b', "''x''": "'x'"}
    assert _one(spark, list(cases), T.unquote_once) == list(cases.values())


def test_bool_like(spark):
    cases = ["", "false", "No", "0", "off", "yes", "FALSE", None]
    assert _one(spark, cases, T.bool_like) == [False, False, False, False, True, True, False, False]


def test_quote_path_matches_urllib(spark):
    from urllib.parse import quote

    cases = ["/a b/c", "/?force=1", "/x~y*z+w", "/é/→", "/a%2Fb", "/setup/api/status?a=b c"]
    assert _one(spark, cases, T.quote_path) == [quote(v) for v in cases]


def test_html_escape(spark):
    import html

    cases = ["<a href=\"x\">'&'</a>", "plain"]
    assert _one(spark, cases, T.html_escape) == [html.escape(v, quote=True).replace("&#x27;", "&#39;") for v in cases]


def test_strip_colour_only_sgr(spark):
    cases = ["\x1b[31mred\x1b[0m", "\x1b[2Kclear", "a\x1b[1;32mb"]
    assert _one(spark, cases, T.strip_colour) == ["red", "\x1b[2Kclear", "ab"]


def test_provider_label_title_case():
    assert T.provider_label("OPENROUTER_API_KEY") == "Openrouter"
    assert T.provider_label("HF_TOKEN") == "Hf"  # suffix removed before the prefix rule
    assert T.provider_label("AWS_ACCESS_KEY_ID") == "Aws Access Key Id"
