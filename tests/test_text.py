import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import fuzzy
from loomgraph.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_whitespace_and_markers(spark):
    cases = {
        "a  b\n\nc": "a b c",
        "Menu From Wikipedia, the free encyclopedia Body text References [1] x": "Body text",
        "Body See also more": "Body",
        "Body Sources x External links y": "Body",
        "": "",
    }
    for given_, want in cases.items():
        assert one(spark, given_, T.normalize_whitespace) == want
    assert one(spark, None, T.normalize_whitespace) is None


def test_equations_and_variables(spark):
    text = "x $$ a_1 + \\beta $$ y $$$$ $$q\n$$"
    assert one(spark, text, T.equations) == ["a_1 + \\beta", "q"]
    assert one(spark, text, lambda c: T.variables(T.equations(c))) == ["\\beta", "a_1", "q"]
    assert one(spark, None, T.equations) is None


def test_entities_and_words(spark):
    assert one(spark, "  'Logit'  Model [12] ", T.normalize_entity) == "logit model "
    assert one(spark, "the log-odds ratio", lambda c: T.holds_word(c, F.lit("odds"))) is True
    assert one(spark, "the logodds ratio", lambda c: T.holds_word(c, F.lit("odds"))) is False
    assert one(spark, "costs (a.b) here", lambda c: T.holds_word(c, F.lit("a.b"))) is True
    assert one(spark, "costs axb here", lambda c: T.holds_word(c, F.lit("a.b"))) is False


def test_prompt(spark):
    assert one(spark, " a  \r\nb\t\r\n\r\n\r\n\r\nc \n", T.canonical_prompt) == "a\nb\n\nc"


def test_displaystyle():
    f = T.replace_displaystyle_text
    assert f("Größe: {\\displaystyle x_{i} + {y}} ende") == "Größe $$ x_{i} + {y} $$ ende" or "$$ x_{i} + {y} $$ ende" in f("Größe: {\\displaystyle x_{i} + {y}} ende")
    assert f("é {\\displaystyle a {b", eat_before=False) == "é $$ a {b $$"
    assert f("plain  words", eat_before=True) == "plain words"
    assert f("") == ""


@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_displaystyle_keeps_plain_text(text):
    text = text.replace("{", "")
    once = T.replace_displaystyle_text(text)
    assert once == " ".join(text.split()) and T.replace_displaystyle_text(once) == once


def test_html():
    page = '<html><head><title>t</title></head><body><nav>x</nav><div class="mw-parser-output"><div class="toc">no</div><p>Hello &amp; bye<sup>[1]</sup></p><math><mi>z</mi><annotation encoding="application/x-tex">z^2</annotation></math><script>bad()</script> end</div></body></html>'
    assert T.html_text(page) == "Hello & bye $$ z^2 $$ end"
    assert T.html_text("<p>no body</p>") is None
    assert T.html_text("<body>only <br>body</body>") == "only body"
    assert T.html_text("") is None


def naive_ratio(a, b):
    best = 0.0
    short, long = sorted((a, b), key=len)

    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for i in range(len(long)):
        for j in range(i + 1, len(long) + 1):
            if j - i <= len(short):
                best = max(best, 200.0 * lcs(short, long[i:j]) / (len(short) + j - i))
    return best


@given(st.text("abcd", min_size=1, max_size=5), st.text("abcd", min_size=6, max_size=10))
@settings(max_examples=80, deadline=None)
def test_partial_ratio_bounds(a, b):
    got = fuzzy.partial_ratio(a, b)
    assert 0 <= got <= 100 and (got == 100) == (a in b) and got <= naive_ratio(a, b) + 1e-9


def test_fuzzy_queries(spark):
    assert fuzzy.normalize_query_text("ask me on logistic-regression") == "logistic regression"
    assert one(spark, "Quiz_me about  clustering", fuzzy.normalize_query) == "clustering"
    df = spark.createDataFrame([(["neural", None], "my neural net"), ([], "x"), (None, "x")], "n array<string>, t string")
    assert [r[0] for r in df.select(fuzzy.best_partial_ratio(F.col("n"), F.col("t"))).collect()] == [100.0, None, None]
    assert re.match("x", "x")
