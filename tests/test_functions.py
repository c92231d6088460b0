import math

from pyspark.sql import functions as F

from heronry.functions import jsons as J
from heronry.functions import text as T
from heronry.functions import vectors as V


def _map(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_text(spark):
    assert _map(spark, T.squeezed, [" a  b\n", None, ""]) == ["a b", None, ""]
    assert _map(spark, T.normalised, ["  Ab\tC "]) == ["ab c"]
    assert _map(spark, T.sentences, ["One. Two!\nThree", None, " "]) == [["One.", "Two!", "Three"], [], []]
    assert _map(spark, T.without_think, ["<think>a\nb</think>c", "<THINK x=1>q</think> d", "<think>open"]) == ["c", " d", "<think>open"]
    assert _map(spark, T.without_verdict_tags, ["ok [Confidence: 9%] [Warning: low]", "ok"]) == ["ok", "ok"]
    assert _map(spark, T.snake_key, ["documentId", "top_k", "aB1C"]) == ["document_id", "top_k", "a_b1_c"]
    assert _map(spark, T.session_title, ["hello world of pumps", "hi", None, "x" * 60, "can you help me"]) == ["World of pumps", "New Chat", None, "X" + "x" * 49 + "...", "Help me"]
    assert _map(spark, T.neutral_tags, ["a<QUERY>b</OUTPUT><x>"]) == ["a< QUERY>b< /OUTPUT><x>"]
    assert _map(spark, T.clean_summary, ["<think>x</think>\n\nAnswer: \n The pump. \n more", "abc", None, "<assistant>fine text"]) == ["The pump.", "", "", "fine text"]
    assert _map(spark, T.is_small_talk, ["Hi there!", "thanks", "who are you?", "", None, "what is the pressure", "hi what is the pump pressure of x", "you"]) == [True, True, True, True, True, False, False, False]
    assert _map(spark, T.calm_spacing, ["a  \n\n\n\nb```x  \n\n\n\n```"]) == ["a\n\nb```x  \n\n\n\n```"]
    assert _map(spark, lambda x: T.preview(x, 3), ["abcd", "abc"]) == ["abc…", "abc"]
    assert _map(spark, T.uploaded_name, ["/up/01234567-89ab-cdef-0123-456789abcdef_x.pdf", "y.pdf"]) == ["x.pdf", "y.pdf"]
    assert _map(spark, lambda x: T.context_bucket(F.length(x)), ["a" * 10, "a" * 20000, "a" * 200000]) == [8192, 16384, 32768]


def test_json(spark):
    m = ['{"metadata": {"original_text": "in"}, "original_text": "out"}', '{"original_text": "out"}', "{broken", None]
    assert _map(spark, lambda x: J.original_text(x, F.lit("col")), m) == ["in", "out", "col", "col"]
    assert _map(spark, J.as_bool, ["TRUE", "yes", "0", "maybe", None]) == [True, True, False, None, None]
    assert _map(spark, J.as_percent, ["72", "2.5", "3.5", "NaN", "x", None]) == [72, 2, 4, 0, 0, 0]
    assert _map(spark, lambda x: J.merged(x, F.lit('{"b":"2"}')), ['{"a":"1","b":"0"}', None, "{bad"]) == ['{"a":"1","b":"2"}', '{"b":"2"}', '{"b":"2"}']


def test_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, []), (7, None)]
    df = spark.createDataFrame(rows, "i int, v array<double>").orderBy("i")
    q = F.array(F.lit(1.0), F.lit(0.0))
    assert [r[0] for r in df.select(V.is_usable(F.col("v"), 2)).collect()] == [True, False, False, False, False, False, False]
    out = df.where("i <= 2").select(V.cosine(F.col("v"), q).alias("c"), V.squared_distance(F.col("v"), q).alias("d"), V.unit(F.col("v")).alias("u")).collect()
    assert math.isclose(out[0]["c"], 0.6) and out[0]["d"] == 20 and out[0]["u"] == [0.6, 0.8]
    assert out[1]["c"] == 0 and out[1]["u"] == [0.0, 0.0]
    assert _map(spark, V.finite_or_null, ["1.5", "NaN", "Infinity", "x", None]) == [1.5, None, None, None, None]
