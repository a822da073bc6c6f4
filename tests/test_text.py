from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions import values as D
from tracelake.operators import search as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_normal_form(spark):
    assert one(spark, T.normal_form("t"), t="  It’s “DONE”,  (really)!\t") == "its done really"
    assert one(spark, T.normal_form("t", unicode=True), t="ﬁnal Ｒeport") == "final report"
    assert one(spark, T.normal_form("t", unicode=True), t=None) is None


def test_cues_follow_the_lists(spark):
    said = lambda t, n: one(spark, T.cue(T.normal_form("t"), n), t=t)
    assert said("It is unfinished.", "completion") == "finished"
    assert said("Finished, due to luck", "completion") is None
    assert said("We can't proceed", "blocking") is None
    assert said("Ana will help; assigned to Bo", "owner_assignment") is None
    assert said("Handed off to Bo", "owner_assignment") == "handed off to"


def test_names_and_words(spark):
    assert one(spark, F.array_sort(T.capitalised_names("t")), t="The plan of O'Neil and X, by Mary-Ann. We agree") == ["mary-ann", "o'neil"]
    assert sorted(one(spark, T.subject_words("a", "b"), a="Quarterly report", b="is due 2024-05-01 on the 3rd, 12/31")) == ["due", "quarterly", "report"]
    assert one(spark, T.jaccard(F.split("a", " "), F.array().cast("array<string>")), a="x y") == 0.0


def test_quote_boundary(spark):
    at = lambda t: one(spark, T.quote_boundary("t"), t=t)
    assert at("Hello\nOn Wed, Jo wrote:\n> x") == 6
    assert at("Hello\n> one\nmore") == len("Hello\n> one\nmore")
    assert at("Hello\n> one\n> two") == 6
    assert at("Hi\n-- \nsig") == 3
    assert at("a\r\n----- Original Message -----\r\nb") == 3
    assert at("") == 0


def test_participants_and_hints(spark):
    p = one(spark, T.participant("t"), t="Ann Lee <Ann@X.example>")
    assert (p["name"], p["email"]) == ("Ann Lee", "ann@x.example")
    assert one(spark, T.participant("t"), t="Bo")["email"] is None
    assert one(spark, T.export_hint("t"), t="a/GMT20240101-120000_x.vtt") == "cloud transcript"
    assert one(spark, T.export_hint("t"), t="x.txt") is None
    assert one(spark, T.masked("t"), t="secret42") == "****et42"


def test_html_and_base64(spark):
    html = "<p>a &amp; b<br>c</p><script>var x = '</p>';</script><style>p{}</style><div> d </div>"
    assert one(spark, T.html_to_text("t"), t=html) == "a & b\nc\n\nd"
    assert one(spark, T.decode_base64url("t"), t="w6kt") == "é-"
    assert one(spark, T.decode_base64url("t"), t="aGk") == "hi"


def test_dates(spark):
    day = lambda v, t: one(spark, D.stated_date(F.col("v"), F.col("t")), v=v, t=t)
    assert day("2024-01-02", "TBD ")["ambiguous"] and day(None, "later on")["ambiguous"] and not day("2024-01-02", None)["ambiguous"]
    assert str(one(spark, D.utc_from_mail_date(F.col("t")), t="Wed, 3 Jan 2024 10:00:00 +0200 (EET)")) == "2024-01-03 08:00:00"
    assert one(spark, D.utc_from_mail_date(F.col("t")), t="nonsense") is None
    assert one(spark, D.ratio(F.lit(1), F.lit(0)), t="x") is None
    assert one(spark, D.weakest_band(F.lit("high"), F.lit("medium")), t="x") == "medium"


def test_search(spark):
    rows = spark.createDataFrame([(1, "Café au lait", "x"), (2, "cafe", "au lait"), (3, "a_b-c", "café AU lait café au lait")], "id int, a string, b string")
    assert [r["id"] for r in S.search(rows, "id", ["a", "b"], "cafe au").collect()] == [3, 1]
    assert S.search(rows, "id", ["a", "b"], "!?").count() == 0
    assert [r["id"] for r in S.search(rows, "id", ["a", "b"], "a b c", limit=1).collect()] == [3]
    tokens = F.split(F.lit("a b c d e f g h"), " ")
    assert rows.limit(1).select(S.snippet(tokens, F.array(F.lit("d")), 3)).first()[0] == "...c [d] e..."
