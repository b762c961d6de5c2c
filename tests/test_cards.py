"""Cards against plain Python: cleaned lines, labels, stations, and methods that the JVM compiles."""

import re

from pyspark.sql import functions as F

from geoflat.operators import extract as E
from geoflat.session import HUGE_METHOD, limit_method_size

TEXTS = ["a\nb", "", " \n ", None, "  a   b\t\r\n\r\n c d\x1c \x85e ", "a  b", "a \nb", "a\n b", "x\x0by\x0cz", "\n", "a\n"]


def test_lines_like_python(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r.id: r.l for r in d.select("id", E.text_lines(F.col("text")).alias("l")).collect()}
    for i, t in enumerate(TEXTS):
        lines = None if t is None else [x for x in (re.sub(r"\s+", " ", y).strip() for y in t.splitlines()) if x]
        assert got[i] == lines, t


def test_card_edges(spark):
    text = ("Характеристики\nСтены\nстарые\nХарактеристики\nОтделка\nбелая\nРемонт\nевро\nСтены\n"
            "Ипотека\nЛифт\nЕсть\nНа карте\nмин\nЮжная 4 мин\nСеверная\n4 мин\nx 4\n5 000 000 ")
    d = spark.createDataFrame([(1, text, "g", "l"), (2, None, "g", "l"), (3, "Лифт", "g", "l")],
                              "id int, text string, source_group string, link string")
    got = {r.id: r for r in E.card_rows(d).collect()}
    r = got[1]
    assert (r.renovation, r.walls, r.elevator, r.metro, r.metro_walk_min, r.price) == ("белая", None, None, "Южная", 4, 5000000)
    assert all(v is None for i in (2, 3) for k, v in got[i].asDict().items() if k not in ("id", "source_group", "link"))


def test_labels_are_looked_up_by_compiled_code(spark):
    d = spark.createDataFrame([("a", "g", "l")], "text string, source_group string, link string")
    plan = E.card_rows(d).select("walls", "elevator", "area_total", "floor")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_methods_stay_compilable(spark):
    spark.conf.set(HUGE_METHOD, "65535")
    limit_method_size(spark)
    assert spark.conf.get(HUGE_METHOD) == "8000"
    spark.conf.set(HUGE_METHOD, "5000")
    limit_method_size(spark)
    assert spark.conf.get(HUGE_METHOD) == "5000"
    spark.conf.set(HUGE_METHOD, "8000")
