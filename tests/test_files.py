"""File-name expressions (FIXTURES F3.4) and time formatting."""

from pyspark.sql import functions as F

from caseledger.functions import files as FF

NAMES = {
    "a.pdf": ("a", "pdf", "pdf"),
    "A.B.PDF": ("A.B", "PDF", "pdf"),
    ".hidden": (".hidden", "", "hidden"),
    "a.": ("a", "", ""),
    "a..pdf": ("a.", "pdf", "pdf"),
    "x.ini": ("x", "", "ini"),
    "noext": ("noext", "", ""),
    "a|b.pdf": ("a|b", "pdf", "pdf"),
    "..a.b": ("..a", "b", "b"),
    "...": ("...", "", ""),
    "a\nb.pdf": ("a\nb", "pdf", "pdf"),
    "x.INI": ("x", "", "ini"),
    "": ("", "", ""),
}


def test_stem_ext(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    n = F.col("n")
    rows = df.select("n", FF.file_stem(n).alias("s"), FF.file_ext(n).alias("e"),
                     FF.file_extension(n).alias("x")).collect()
    for r in rows:
        assert (r["s"], r["e"], r["x"]) == NAMES[r["n"]], r["n"]


def test_noise(spark):
    df = spark.createDataFrame([("desktop.ini",), ("Desktop.INI",), ("desk.ini",)], "n string")
    got = [r[0] for r in df.select(FF.is_noise_file(F.col("n"))).collect()]
    assert got == [True, True, False]


def test_iso_utc_and_url(spark):
    df = spark.createDataFrame([(1600000000.0, "x1", "drive"), (1600000000.25, "x2", "local")],
                               "e double, id string, src string")
    rows = df.select(FF.iso_utc(F.col("e")).alias("t"),
                     FF.file_url(F.col("id"), F.col("src")).alias("u")).collect()
    assert rows[0]["t"] == "2020-09-13T12:26:40+00:00"
    assert rows[1]["t"] == "2020-09-13T12:26:40.250000+00:00"
    assert rows[0]["u"].endswith("/d/x1/view")
    assert rows[1]["u"] == ""


def test_iso_utc_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(0.0,)], "e double")
        assert df.select(FF.iso_utc(F.col("e"))).first()[0] == "1970-01-01T00:00:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
