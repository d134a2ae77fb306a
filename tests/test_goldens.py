"""Known answers: functions, JSON paths, measures, log tails, sequences.

Fixed values: the URL cases, the log tails, the measure vectors and their answers are published ones that results must match.
"""

import pytest
from pyspark.sql import functions as F

from webloom.functions import jsonpath as J
from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.functions import vectors as V
from webloom.operators import features as X
from webloom.operators import fetchlog as L
from webloom.operators import measures as M
from webloom.operators import ordered as O
from webloom.sources import files as S


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, normal, error", [
    ("facebook.com/", "http://facebook.com", None),
    ("http://facebook.com/", "http://facebook.com", None),
    ("https://facebook.com/", "https://facebook.com", None),
    ("", None, U.EMPTY_URL),
    ("http://facebook", None, U.NO_DOMAIN),
    ("facebook", None, U.NO_DOMAIN),
    ("https://en.wikipedia.org/wiki/Email_address", "https://en.wikipedia.org/wiki/Email_address", None),
    ("%2i23jr93udn.com", None, U.BAD_ESCAPE),
])
def test_normalize_url(spark, raw, normal, error):
    got = U.normalize_url(F.lit(raw))
    row = spark.range(1).select(got[0].alias("url"), got[1].alias("error")).first()
    assert (row["url"], row["error"]) == (normal, error)


def test_short_texts(spark):
    assert one(spark, T.abbrev(F.lit("copy the long log of tuesday to the old disk"), 10)) == "copy..disk"
    assert [one(spark, T.left_abbrev(F.lit(s), 5)) for s in ("helloworld", "hello", "ok")] == ["..rld", "hello", "ok"]
    assert one(spark, T.trim_space(F.lit("\n\t wide open \n\t  field\nend\n\n"))) == "wide open field.end"
    assert [one(spark, T.trim_path(F.lit(s))) for s in ("/opt/tools/sort -r list", "/opt/tools/cat", "/a/long/way/")] == [
        "../sort -r list", "../cat", "../way/"]
    assert one(spark, T.title_case(F.lit("the last of the mohicans"))) == "The Last of the Mohicans"
    assert [one(spark, T.format_bytes(F.lit(n))) for n in (0, 512, 1024, 1536, 1048576, 3 * 1024**3)] == ["0", "512B", "1K", "1.5K", "1M", "3G"]
    assert [one(spark, T.parse_short_number(F.lit(s))) for s in ("1.2k", "3m", "17", "x")] == [1200, 3000000, 17, 0]
    assert one(spark, T.parse_duration(F.lit("1h 56min"))) == 116
    assert str(one(spark, T.parse_french_date(F.lit("11 octobre 2017")))) == "2017-10-11"
    assert one(spark, T.to_int(F.lit("99999999999"))) == 2**31 - 1
    assert one(spark, T.common_prefix(F.lit("abcd"), F.lit("abx"))) == "ab"
    assert one(spark, T.heading(F.lit("  The Owner's Manual "))) == "The Owner's Manual"
    assert one(spark, T.heading(F.lit("No heading."))) == ""


def test_replace_rules(spark):
    assert one(spark, T.sed_replace(F.lit("aXbXc"), "s/X/$1/")) == "a$1bXc"
    assert one(spark, T.sed_replace(F.lit("aXbXc"), "s|X|-|g")) == "a-b-c"
    assert T.sed_parts("strong") is None and T.sed_parts("s/a/b/x") is None and T.sed_parts("s//b/") is None


def test_template(spark):
    filled = T.fill_template("http://x.com/{{ a }}?q={{ b }}&n={{ c:10 }}", {"a": F.lit("p q"), "b": F.lit("p q")})
    assert one(spark, filled) == "http://x.com/p q?q=p+q&n=10"
    with pytest.raises(ValueError, match="missing param"):
        T.fill_template("{{ a }}", {})


def test_mail_parts(spark):
    assert one(spark, T.parse_email(F.lit("joe@example.com"))).asDict() == {"user": "joe", "host": "example.com", "domain": "example", "tld": "com"}
    assert one(spark, T.parse_number(F.lit("-12.3E+5"))).asDict() == {"sign": "-", "whole": "12", "frac": "3", "exp_sign": "+", "exp": "5"}
    found = one(spark, T.find_emails(F.lit("mail joe@example.com or ann at site dot org or joe@example.com"), ("ann",)))
    assert found == ["joe@example.com"]


def test_private_ranges(spark):
    inside = ["10.0.0.0", "10.255.255.254", "100.64.0.1", "172.31.0.0", "192.0.0.5", "192.168.1.1", "198.19.0.0"]
    outside = ["10.255.255.255", "11.0.0.0", "172.32.0.0", "192.168.255.255", "8.8.8.8", "not an ip"]
    assert all(one(spark, U.is_private_ip(F.lit(ip))) for ip in inside)
    assert not any(one(spark, U.is_private_ip(F.lit(ip))) for ip in outside)


def test_json_path(spark):
    doc = F.parse_json(F.lit('{"a":[{"b":1},{"b":2}],"n":null}'))
    text = lambda path: one(spark, F.to_json(J.json_path(doc, path)))
    assert text("a[0].b") == "1"
    assert text("a[:].b") == "[1,2]"
    assert text("a.(b=1)[0].b") == "1"
    assert text("a[-1].b") == "2"
    assert text("a.b") == "[1,2]"
    assert text("missing.key") is None


def test_jsonp(spark):
    got = [one(spark, J.unwrap_jsonp(F.lit(s))) for s in ('cb({"a":1});', '(function(){cb({"a":1});})();', '{"a":"(x)"}', "plain")]
    assert got == ['{"a":1}', '{"a":1}', '{"a":"(x)"}', "plain"]


def scored(spark, rows):
    return spark.createDataFrame([(i, list(p), t) for i, (p, t) in enumerate(rows)], "id long, pred array<double>, target int")


BINARY = [((0.9, 0.1), 0), ((0.6, 0.4), 0), ((0.65, 0.35), 1), ((0.2, 0.8), 1)]
FOUR = [((0.7, 0.1, 0.1, 0.1), 0), ((0.3, 0.5, 0.1, 0.2), 0), ((0.1, 0.9, 0.0, 0.0), 1), ((0.1, 0.7, 0.05, 0.15), 2)]


def test_measures(spark):
    acc = scored(spark, [((0.7, 0.3), 0), ((0.4, 0.5), 0), ((0.1, 0.9), 1), ((0.2, 0.8), 1)])
    assert M.accuracy_at_k(acc, [1]).first()[0] == 0.75
    # The fourth row's target is its least likely class, so only four guesses reach it.
    assert tuple(M.accuracy_at_k(scored(spark, FOUR), [1, 2, 3, 4]).first()) == (0.5, 0.75, 0.75, 1.0)
    assert M.accuracy_at_k(scored(spark, FOUR), [9]).first()[0] == 0.0
    assert M.auc(scored(spark, BINARY), F.get("pred", 1), F.col("target") == 1).first()["auc"] == 0.75
    assert M.auc(scored(spark, BINARY[:2]), F.get("pred", 1), F.col("target") == 1).first()["auc"] == 1.0
    assert scored(spark, BINARY).agg(M.matthews_column()).first()[0] == pytest.approx(0.57735, abs=1e-5)
    gini = spark.createDataFrame([(0, 1.0, 0.86), (1, 1.0, 0.26), (2, 0.0, 0.52), (3, 1.0, 0.32)], "id long, a double, p double")
    assert M.gini(gini, "a", "p", "id").first()["gini"] == pytest.approx(-1 / 3, abs=1e-9)
    told = gini.selectExpr("id", "array(p) as pred", "cast(a as int) as target")
    row = M.measure_report(told, ["gini", "eucll", "loss", "iteration"], 1, regression=True, known={"loss": 0.5, "iteration": 7.0}).first()
    assert row["gini"] == pytest.approx(-1 / 3, abs=1e-9) and (row["loss"], row["iteration"]) == (0.5, 7.0)
    assert row["eucll"] == pytest.approx((0.14**2 + 0.74**2 + 0.52**2 + 0.68**2) / 4)


def test_report_from_one_confusion_table(spark):
    rows = scored(spark, [([0.9, 0.1, 0.0], 0), ([0.2, 0.8, 0.0], 0), ([0.1, 0.9, 0.0], 1), ([0.4, 0.6, 0.0], 1)])
    row = M.measure_report(rows, ["acc", "f1", "cmdiag", "cmfull", "mcc", "eucll"], 3).first()
    assert row["cmdiag"] == pytest.approx([0.5, 1.0, 0.0], abs=1e-6) and row["cmfull"] == [[0.5, 0.5, 0.0], [0.0, 1.0, 0.0], [None] * 3]
    assert row["accp"] == row["acc"] == 0.75 and row["mcc"] == pytest.approx(0.57735, abs=1e-5)
    assert row["precision"] == pytest.approx(0.5, abs=1e-6) and row["recall"] == pytest.approx((1 + 2 / 3) / 3, abs=1e-6)
    with pytest.raises(ValueError):
        M.measure_report(scored(spark, [([0.5, 0.5], 2)]), ["f1"], 2)
    for bad in ("loss", "accuracy", "unheard"):
        with pytest.raises(ValueError):
            M.measure_report(rows, [bad], 3)
    empty = M.measure_report(rows.limit(0), ["acc", "f1", "cmfull"], 2).first()
    assert empty["rows"] == 0 and empty["f1"] is None and empty["cmfull"] == [[None, None], [None, None]]


def test_confusion(spark):
    rows = scored(spark, FOUR)
    got = M.precision_recall_f1(rows, 4).first()
    assert got["accp"] == 0.5
    assert got["f1"] == pytest.approx(0.35294117352941187, rel=1e-9)
    assert got["precision"] == pytest.approx(0.3749999968750001, rel=1e-9)
    assert got["recall"] == pytest.approx(0.3333333305555556, rel=1e-9)
    shares = {(r["target"], r["predicted"]): r["share"] for r in M.confusion_full(rows, 4).collect()}
    assert [shares[0, p] for p in range(4)] == [0.5, 0.5, 0.0, 0.0]
    assert shares[2, 1] == 1.0 and shares[3, 0] is None


def test_sequence_measure(spark):
    rows = spark.createDataFrame([([0, 1, 1, 1], [0, 0, 1, 1])], "p array<int>, t array<int>")
    assert M.per_position_accuracy(rows, "p", "t", 2).first()["acc"] == 0.75


def test_log_tail(spark):
    log = lambda n: spark.createDataFrame([(i, f"m{i}") for i in range(n)], "i long, m string")
    tail = lambda n, k: [r["message"] for r in L.latest_messages(log(n), k, ["i"], "m").orderBy("pos").collect()]
    assert tail(0, 3) == ["", "", ""]
    assert tail(3, 3) == ["m0", "m1", "m2"]
    assert tail(5, 3) == ["m2", "m3", "m4"]
    with pytest.raises(ValueError):
        L.latest_messages(log(1), -1, ["i"], "m")
    two = log(5).withColumn("site", F.col("i") % 2)
    got = sorted(map(tuple, L.latest_messages(two, 3, ["i"], "m", by=["site"]).collect()))
    assert got == [(0, 1, "m0"), (0, 2, "m2"), (0, 3, "m4"), (1, 1, ""), (1, 2, "m1"), (1, 3, "m3")]


def sequence(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, v int")


def test_sequences(spark):
    parts = O.split_on_marker(sequence(spark, [0, 1, 2, 1, 2]), ["pos"], F.col("v") == 1).orderBy("pos")
    assert [r["part"] for r in parts.collect()] == [0, 1, 1, 2, 2]
    even = O.runs(sequence(spark, [2, 1, 2, 4]), ["pos"], F.col("v") % 2 == 0).orderBy("first")
    assert [(r["first"]["pos"], r["size"]) for r in even.collect()] == [(0, 1), (2, 2)]


def test_distances(spark):
    ints = lambda values: F.array(*[F.lit(v) for v in values])
    assert one(spark, V.prefix_distance(ints([1, 0, 3, 4, 5, 6]), ints([1, 0, 2, 2, 2, 2, 2, 2]))) == 6
    assert one(spark, V.boost(F.lit(0.5))) == 0.75


def test_one_hot(spark):
    rows = spark.createDataFrame([("p", "x"), ("e", "x"), ("e", "b")], "target string, shape string")
    got = X.OneHot(["target", "shape"]).fit(rows).transform(rows)
    assert got.columns == ["target_e", "target_p", "shape_b", "shape_x"]
    assert [tuple(r) for r in got.collect()] == [(0, 1, 0, 1), (1, 0, 0, 1), (1, 0, 1, 0)]


def test_unknown_category_is_an_error(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "z")], "id long, c string")
    mapping = spark.createDataFrame([("a", 0)], "value string, index long")
    with pytest.raises(Exception, match="unknown category"):
        X.categorical_mapping(rows, "c", mapping, "id").collect()


def test_scaling_keeps_constants_and_does_not_clip(spark):
    fitted = X.MinMaxScale(["a", "b"]).fit(spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "a double, b double"))
    assert tuple(fitted.transform(spark.createDataFrame([(20.0, 7.0)], "a double, b double")).first()) == (2.0, 7.0)


def test_csv_errors(spark, tmp_path):
    path = str(tmp_path / "rows.csv")
    with open(path, "w") as f:
        f.write("id,a,b\r\n1,2.5,x\r\n2,,y\r\n")
    read = S.scan_csv(spark, path, id="id", ignore=("b",))
    assert [tuple(r) for r in S.scan_csv_numeric(read).collect()] == [(1.0, 2.5), (2.0, None)]
    with pytest.raises(ValueError, match="no column label"):
        S.scan_csv(spark, path, label="label")
    with pytest.raises(ValueError, match="column b"):
        S.scan_csv_numeric(S.scan_csv(spark, path))


def test_sitemaps(spark):
    files = spark.createDataFrame([
        ("http://a/index", "<sitemapindex><sitemap><loc>http://a/1</loc></sitemap></sitemapindex>"),
        ("http://a/1", "<urlset><url>\n<loc> http://a/p?x=1&amp;y=2 </loc><priority>1</priority></url></urlset>"),
        ("http://a/2", "li da da")], "loc string, body string")
    assert [r["url"] for r in S.scan_sitemap_any(files, files).collect()] == ["http://a/p?x=1&y=2"] * 2
    assert S.scan_sitemap(files.filter("loc = 'http://a/2'")).count() == 0
