import hypothesis.strategies as st
import pytest
from hypothesis import HealthCheck, given, settings
from lodeleaf.functions import text as T
from lodeleaf.functions.embedding import HashingEmbedder, get_embedder, tokens_of
from lodeleaf.functions.vectors import dot, norm
from lodeleaf.config import Config
from pyspark.sql import functions as F

TEXTS = ["Error E1002: disk_full, 12.5 MB!", "审计链条 v2 和用語集", "é ü naïve", "", "  　 ", "中", "a_b c-d 한국", "X" * 50]


def test_tokens_agree_with_python(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", T.tokenize(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: tokens_of(t) for i, t in enumerate(TEXTS)}
    assert tokens_of("用語 ab 中") == ["ab", "用", "語", "用語", "中"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aB1_ é中文カ。", max_size=30))
def test_tokens_property(spark, t):
    assert spark.createDataFrame([(t,)], "t string").select(T.tokenize(F.col("t"))).first()[0] == tokens_of(t)


def test_strip_takes_wide_blanks(spark):
    rows = spark.createDataFrame([("　 a b\x1c\n",), (None,), ("",)], "t string").select(T.strip(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["a b", None, ""]


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(T.bigrams(F.col("t"))).collect()] == [["a_b", "b_c"], [], []]


def test_sentences_and_location(spark):
    df = spark.createDataFrame([("One. Two! 三。\n\nrest",), (" \n ",)], "t string").select(T.sentences(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [["One.", " Two!", " 三。", "rest"], [" \n "]]
    loc = spark.createDataFrame([("T", 2, 1, 9, "A > B"), ("T", 2, 1, 9, None)], "t string, p int, s int, e int, x string")
    assert [r[0] for r in loc.select(T.location(*map(F.col, "tpsex"))).collect()] == ["T#p2:1-9 (A > B)", "T#p2:1-9"]


@pytest.mark.parametrize("turns, want", [(0, "q d"), (1, "q c d"), (2, "q b c d"), (9, "q a b c d")])
def test_history_turns(spark, turns, want):
    df = spark.createDataFrame([("q", ["a", "b", "c"], ["d"])], "q string, h array<string>, t array<string>")
    assert df.select(T.expand_query(F.col("q"), F.col("h"), F.col("t"), turns)).first()[0] == want


def test_hashing_embedder(spark):
    e = HashingEmbedder(16)
    v = e.embed(["Error E1002 error", "", "ERROR e1002 error"])
    assert v[0] == v[2] and abs(sum(x * x for x in v[0]) - 1) < 1e-12 and not any(v[1])
    rows = spark.createDataFrame([("Error E1002 error",), (None,)], "t string").select(e.column(F.col("t"))).collect()
    assert rows[0][0] == v[0] and not any(rows[1][0])
    assert all(0 <= e.place(t)[0] < 16 and e.place(t)[1] in (1, -1) for t in "abcdef")


def test_unknown_embedder():
    with pytest.raises(ValueError):
        get_embedder(Config(embedder="other"))
    with pytest.raises(RuntimeError):
        get_embedder(Config(embedder="sentence-transformers"))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    rows = df.select(dot(F.col("a"), F.col("b")).alias("d"), norm(F.col("a")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [(11.0, 5.0), (None, 1.0), (None, None)]


def test_config():
    with pytest.raises(ValueError):
        Config(chunk_size=100, chunk_overlap=100)
    assert Config().fingerprint() == Config(llm_api_key="secret", reasoning_api_key="x", store_path="other").fingerprint()
    assert Config().fingerprint() != Config(top_k=6).fingerprint() and len(Config().fingerprint()) == 16
    assert Config().is_offline and not Config(allow_network=True).is_offline and not Config(allow_network=True).offline_environment()
