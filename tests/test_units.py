import pytest

from quillgraph.functions import units


def measured(spark, rows):
    df = spark.createDataFrame(rows, "id string, name string, props map<string,string>, extra int") if rows else spark.createDataFrame([], "id string, name string, props map<string,string>, extra int")
    return {r["id"]: (r["quantity"], r["value_int"]) for r in units.measured_quantities(df).collect()}


CASES = {
    "球镜+4.00 dpt": ("refraction", 400), "等效球镜−17.00ds": ("refraction", -1700), "离焦量 约 一千零五十度": ("refraction", 1050), "两千度 (复查)": ("refraction", 2000),
    "右眼球镜4,50 D (复查)": ("refraction", 450), "sphere －１５２５ 度 (复查)": ("refraction", -1525), "眼压 约 2.15千帕（非接触）": ("pressure", 161), "术后眼压25mm Hg": ("pressure", 250),
    "晨间眼压十一毫米汞柱（非接触）": ("pressure", 110), "术后眼压1990Pa": ("pressure", 149), "axial length 23,910 微米(均值)": ("length", 23910), "眼轴2.774cm(均值)": ("length", 27740),
    "瞳孔直径 约 5.7MM(均值)": ("length", 5700), "drops 万分之五": ("concentration", 500), "浓度0.005％": ("concentration", 50), "含药凝胶0.05 mg/mL溶液": ("concentration", 50),
    "散瞳剂2500μg/mL溶液": ("concentration", 2500), "近距用眼1 h 15 min/次": ("duration", 75), "遮盖训练半小时": ("duration", 30), "近距用眼半个小时": ("duration", 30), "停戴11个小时": ("duration", 660),
    "户外活动:12 days": ("duration", 17280), "停戴 约 两个半小时": ("duration", 150), "佩戴时长170分": ("duration", 170), "OD 90 min 5": None, "眼轴30毫米": ("length", 30000),
    "体温37.9度": None, "散光轴位94度": None, "倾斜39度角": None, "axis 27°": None, "年龄4岁": None, "患病率8%": None, "顺应性72％": None, "灵敏度 84%": None, "满意度3分": None, "第27代镜片": None,
    "3D打印镜架B款": None, "LX-48D型主机": None, "维生素D3": None, "房号93": None, "2022年普查": None, "近视": None, "": None, None: None,
}


def test_cases(spark):
    rows = [(str(i), name, None, 1) for i, name in enumerate(CASES)]
    found = measured(spark, rows + rows)
    assert {name: found.get(str(i)) for i, name in enumerate(CASES)} == CASES


def test_order_of_units(spark):
    rows = [("a", "眼压16", {"unit": "kPa"}, "x"), ("b", "眼压16", None, "x"), ("c", "眼压16", None, "y"), ("d", "眼压16", {"unit": ""}, "x"), ("e", "眼压16 Pa", None, "x"), ("f", "眼压16 Pa", {"unit": "kPa"}, None)]
    df = spark.createDataFrame(rows, "id string, name string, props map<string,string>, source string")
    found = {r["id"]: r["value_int"] for r in units.measured_quantities(df, source_units={"x": "mmHg"}).collect()}
    assert found == {"a": 1200, "b": 160, "d": 160, "e": 1, "f": 1200}


def test_unit_in_props_and_empty(spark):
    rows = [("a", "停戴 4.5/次", {"unit": "h"}, 1), ("b", "OD 0.75 (复查)", {"unit": "DS"}, 1), ("c", "OD 0.75", {}, 1), ("d", "眼压16", {"unit": "岁"}, None)]
    assert measured(spark, rows) == {"a": ("duration", 270), "b": ("refraction", 75)}
    assert measured(spark, []) == {}


@pytest.mark.parametrize(("word", "value"), [("十", 10), ("十五", 15), ("二十", 20), ("一百零五", 105), ("三千", 3000), ("两千零五十", 2050), ("九", 9), ("半", 0.5)])
def test_numerals(spark, word, value):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(word,)], "x string").select(units.number_of_words(F.col("x"))).first()[0] == value
