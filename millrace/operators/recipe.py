"""Cleaning of recipe records: normalise, correct, strip noise, repair, fall back on titles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.hashing import prompt
from millrace.functions.text import any_of, is_unknown, kept_lines, nfc, nfc_each, normalized, simply_cleaned
from millrace.functions.variant import LISTS, TEXTS
from millrace.operators import base_rules
from millrace.operators.rules import Compiled, Rule

CHANGE = "array<struct<rule: string, field: string, count: int, reason: string>>"
FLAG = "array<struct<code: string, field: string, detail: string>>"
MEDIA_RULES = ("standalone_media_step", "trailing_media_reference")
STRUCTURAL = ("missing_ingredients", "missing_instructions", "missing_name", "not_object")

#: The detail of a line that is no JSON; parsers word it differently, so it is the same for all.
INVALID = "不是合法的 JSON"

_LONG_TITLE, _SHORT_TITLE = 60, 30
_HAN = r"一-鿿"
UNITS = any_of("千克", "公斤", "毫升", *"克升勺匙个只片根颗粒块杯瓣条朵头枚份盒把")
_ONE_TO_TEN = "[半一二两三四五六七八九十]"
_REVERSED = rf"(?U)\A({UNITS})([{_HAN}A-Za-z][{_HAN}A-Za-z/、()（）\s]*?)[\s:：.。]*(\d+(?:\.\d+)?|{_ONE_TO_TEN})\z"
_PLACEHOLDERS = "材料 材料如下 用料 用量 食材 食材如下 配料 配料如下 见步骤".split()
_SEE = any_of("看", "见", "参考") + any_of("图片", "图", "视频")
_DEPENDENT = any_of(
    any_of(*"步骤 做法 调法 比例 用量 用料 食材 配料 材料".split()) + ".{0,6}" + _SEE,
    any_of("直接", "具体", "详细", "主要", "只能", "只好", "只", "就") + r"\s*" + _SEE,
    "不知道怎么(?:说|描述).{0,10}" + _SEE,
)
_GENERIC = r"(?iuUd)\A" + any_of(
    "(?:上传|传图)(?:专用)?", "杂七杂八的?记录", "食材之美", "(?:我的)?(?:成品|作品)(?:合集|记录|集)",
    "(?:减脂餐|早餐|便当|蛋糕|烘焙)?打卡(?:记录)?", "记录(?:我做的)?(?:家常菜|早餐|便当|美食)?",
) + r"\z"


def repaired_order(text: Column) -> Column:
    """Quantity, unit and name in their order, where a scraper mixed them up: unit name amount,
    a unit after `some`, and a doubled measure word."""
    text = F.regexp_replace(text, _REVERSED, "$3$1$2")
    text = F.regexp_replace(text, f"^适量克(?=[{_HAN}])", "适量")
    return F.regexp_replace(text, rf"^({_ONE_TO_TEN})([根个颗片块只瓣条])\2", "$1$2")


def is_placeholder(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[()（）;；:：,，。\s]+", "").isin(*_PLACEHOLDERS)


def is_generic_title(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"(?U)[\s/\\|｜:：_—-]+", ""), r"^[~～!！.。]+|[~～!！.。]+$", "")
    return bare.rlike(_GENERIC)


def _flag(code: str, field_: str | None, detail) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(field_).cast("string").alias("field"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))


def _change(rule: str, field_: str, reason: str) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(field_).alias("field"), F.lit(1).alias("count"), F.lit(reason).alias("reason"))


def _when(cond: Column, item: Column, kind: str) -> Column:
    return F.when(cond, F.array(item).cast(kind)).otherwise(F.array().cast(kind))


@dataclass
class Rulebook:
    """What cleaning depends on."""

    typos: list[Rule] = field(default_factory=lambda: list(base_rules.TYPOS))
    noise: list[Rule] = field(default_factory=lambda: list(base_rules.NOISE))
    protected: list[str] = field(default_factory=lambda: list(base_rules.PROTECTED))


def _cleaned_text(df: DataFrame, name: str, book: Rulebook) -> DataFrame:
    lines = name == "description"
    typos, noise = Compiled.of(book.typos, name, book.protected), Compiled.of(book.noise, name, book.protected)
    df = df.withColumn(name, normalized(F.col(name), lines))
    if not typos.rules and not noise.rules:
        return df.withColumn(f"_changes_{name}", F.array().cast(CHANGE))
    df = df.withColumn("_t", typos.apply(F.array(name))[0])
    df = df.withColumn("_n", noise.apply(F.array("_t.text"))[0])
    changes = F.concat(typos.changes(F.col("_t.counts"), name).cast(CHANGE), noise.changes(F.col("_n.counts"), name).cast(CHANGE))
    return df.withColumn(name, normalized(F.col("_n.text"), lines)).withColumn(f"_changes_{name}", changes).drop("_t", "_n")


def _cleaned_list(df: DataFrame, name: str, book: Rulebook) -> DataFrame:
    typos, noise = Compiled.of(book.typos, name, book.protected), Compiled.of(book.noise, name, book.protected)
    df = df.withColumn("_size", F.size(name)).withColumn("_raw", F.transform(nfc_each(F.col(name)), kept_lines))
    df = df.withColumn("_t", typos.apply(F.col("_raw")))
    df = df.withColumn("_n", noise.apply(F.transform("_t", lambda s: s["text"])))
    df = df.withColumn("_text", nfc_each(F.transform("_n", lambda s: kept_lines(s["text"]))))
    media = [i for i, r in enumerate(noise.rules) if r.id in MEDIA_RULES]
    food, steps = name == "recipeIngredient", name == "recipeInstructions"

    def item(z: Column) -> Column:
        before = z["_t"]["text"]
        changes = F.concat(typos.changes(z["_t"]["counts"], name).cast(CHANGE), noise.changes(z["_n"]["counts"], name).cast(CHANGE))
        text, gone = z["_text"], F.lit(False)
        if food:
            fixed = z["_fixed"]
            gone = is_placeholder(fixed)
            changes = F.concat(
                _when(fixed != text, _change("repair_ingredient_order", name, "修复抓取数据中数量、单位和食材顺序颠倒"), CHANGE),
                _when(gone, _change("remove_ingredient_placeholder", name, "删除不包含实际食材的材料或配料占位项"), CHANGE), changes,
            )
            text = fixed
        hit = F.lit(False)
        for i in media if steps else ():
            hit = hit | (F.element_at(z["_n"]["counts"], i + 1) > 0)
        kept = F.when(gone, "").otherwise(text)
        return F.struct(
            kept.alias("text"), changes.alias("changes"), (before.rlike(f"(?Ud){_DEPENDENT}") if food or steps else F.lit(False)).alias("dependent"),
            ((kept == "") & (before != "") & hit).alias("removed"),
        )

    df = df.withColumn("_fixed", F.transform("_text", repaired_order) if food else F.col("_text"))
    df = df.withColumn("_items", F.transform(F.arrays_zip("_t", "_n", "_text", "_fixed"), item))
    df = df.withColumn(name, F.filter(F.transform("_items", lambda s: s["text"]), lambda x: x != ""))
    df = df.withColumn(f"_changes_{name}", F.flatten(F.transform("_items", lambda s: s["changes"])))
    dependent = F.transform(F.filter("_items", lambda s: s["dependent"]), lambda s: _flag("media_reference", name, "关键食材、用量或操作依赖缺失的图片或视频"))
    flags = dependent.cast(FLAG)
    if steps:
        lost = F.size(F.filter("_items", lambda s: s["removed"]))
        detail = F.concat(lost.cast("string"), F.lit("/"), F.col("_size").cast("string"), F.lit(" 个步骤完全依赖缺失图片"))
        flags = F.concat(flags, _when((F.size(name) > 0) & (lost >= 2) & (lost * 2 >= F.col("_size")), _flag("media_dependent", None, detail), FLAG))
    return df.withColumn(f"_flags_{name}", flags).drop("_size", "_raw", "_t", "_n", "_text", "_fixed", "_items")


def cleaned(records: DataFrame, book: Rulebook | None = None) -> DataFrame:
    """records (see variant.records) with cleaned fields, `changes`, and the structural `flags`."""
    book = book or Rulebook()
    df = records
    for name in TEXTS:
        df = _cleaned_text(df, name, book)
    for name in LISTS:
        df = _cleaned_list(df, name, book)
    name, dish = F.col("name"), F.col("dish")
    df = df.withColumn("_generic", is_generic_title(name)).withColumn("_usable", ~is_unknown(dish) & ~is_generic_title(dish) & (F.length(dish) <= _SHORT_TITLE))
    case = (
        F.when(is_unknown(name), 1).when((F.length(name) > _LONG_TITLE) & F.col("_usable"), 2)
        .when(F.col("_generic") & F.col("_usable") & (dish != name), 3).otherwise(0)
    )
    df = df.withColumn("_case", case).withColumn("name", F.when(F.col("_case") > 0, dish).otherwise(name))
    title = F.concat(
        _when(F.col("_case") == 2, _change("short_dish_name_fallback", "name", "食谱标题过长，使用简短 dish 生成自然提示词"), CHANGE),
        _when(F.col("_case") == 3, _change("generic_title_dish_fallback", "name", "标题是传图、记录或打卡占位词，改用有效 dish"), CHANGE),
    )
    missing = [
        (is_unknown(F.col("name")), _flag("missing_name", None, "name 和 dish 均无有效菜名")),
        (F.size("recipeIngredient") == 0, _flag("missing_ingredients", None, "没有有效食材")),
        (F.size("recipeInstructions") == 0, _flag("missing_instructions", None, "没有有效制作步骤")),
    ]
    fields = [*TEXTS, *LISTS]
    flags = F.concat(*[F.col(f"_flags_{n}") for n in LISTS], *[_when(c, f, FLAG) for c, f in missing])
    none = F.when(F.col("valid"), F.array(_flag("not_object", None, "JSON 行不是对象")).cast(FLAG)).otherwise(F.array(_flag("invalid_json", None, INVALID)).cast(FLAG))
    changes = F.concat(*[F.col(f"_changes_{n}") for n in fields], title)
    df = df.withColumn("flags", F.when(F.col("object"), flags).otherwise(none)).withColumn("changes", F.when(F.col("object"), changes).otherwise(F.array().cast(CHANGE)))
    return df.drop("_generic", "_usable", "_case", *[f"_changes_{n}" for n in fields], *[f"_flags_{n}" for n in LISTS])


def output_text(description: Column, ingredients: Column, steps: Column) -> Column:
    """The answer of a training row: what it is, what it needs, and the numbered steps."""
    needs = F.concat(F.lit("食材：\n"), F.array_join(F.transform(ingredients, lambda x: F.concat(F.lit("- "), x)), "\n"))
    how = F.concat(F.lit("制作步骤：\n"), F.array_join(F.transform(steps, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"))
    return F.concat(F.when(description != "", F.concat(F.lit("简介："), description, F.lit("\n\n"))).otherwise(""), needs, F.lit("\n\n"), how)


def training_row(name: Column, output: Column) -> Column:
    return F.struct(prompt(name).alias("instruction"), F.lit("").alias("input"), output.alias("output"))


def converted(records: DataFrame) -> DataFrame:
    """The simple converter: (instruction, input, output) of the records that have all parts, without
    rules and without NFC. Other columns of records are kept."""
    items = lambda n: F.filter(F.transform(n, lambda x: simply_cleaned(x, True)), lambda x: x != "")
    df = records.where("object").withColumns({"name": simply_cleaned(F.col("name")), "dish": simply_cleaned(F.col("dish")), "description": simply_cleaned(F.col("description"), True)})
    df = df.withColumns({n: items(n) for n in LISTS[:2]})
    df = df.withColumn("name", F.when(is_unknown(F.col("name")), F.col("dish")).otherwise(F.col("name")))
    df = df.where(~is_unknown(F.col("name")) & (F.size(LISTS[0]) > 0) & (F.size(LISTS[1]) > 0))
    row = training_row(F.col("name"), output_text(F.col("description"), F.col(LISTS[0]), F.col(LISTS[1])))
    return df.withColumn("_row", row).drop(*TEXTS, *LISTS, "valid", "object").select("*", "_row.*").drop("_row")


def slim(records: DataFrame) -> DataFrame:
    """The fields that rule mining reads, normalised with their lines kept; objects only."""
    df = records.where("object")
    for n in TEXTS:
        df = df.withColumn(n, kept_lines(nfc(F.col(n))))
    for n in LISTS[:2]:
        df = df.withColumn(n, F.filter(nfc_each(F.transform(n, kept_lines)), lambda x: x != ""))
    return df.drop("keywords", "valid", "object")
