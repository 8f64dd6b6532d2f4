"""Flags for cleaned records that look wrong."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import any_of, plain, plain_length
from millrace.operators.base_rules import CONTACT
from millrace.operators.recipe import FLAG, UNITS, _flag, _when, is_generic_title, output_text

MOST, LEAST = 8_000, 35
_POINT = r"(?:\.\d+)?"
_NUMBER = rf"\d+{_POINT}"
_CELSIUS = rf"(?iuU)(-?{_NUMBER})\s*(?:摄氏度|℃|°\s*C)"
_DEGREES = rf"(?U)(\d{{3,4}}{_POINT})\s*度"
_DURATION = rf"(?U)({_NUMBER})\s*(分钟|小时|天)"
_AMOUNT = rf"(?iuU)(\d{{5,}}{_POINT})\s*" + any_of("毫升", "克", "ml", "g") + "(?![A-Za-z])"
_SLOW = any_of(*"内吃完 冷藏 冷冻 保存 存放 密封 保质 赏味 浸泡 泡发 泡菜 发酵 醒发 醒面 风干 盐渍 咸蛋 腌 腊 酿 晾 晒".split())
_SLOW_TITLE = any_of(*"果脯 蜜饯 泡菜 咸蛋 风干 发酵 盐渍 腌 腊 酿 酒".split())
_POULTRY = r"(?:左右|以上|以下)?(?:大的|的)?\s*仔?[鸡鸭鹅鸽]"
_LIMITS = {"分钟": (1440, 10080), "小时": (168, 2160), "天": (30, 730)}
_AROUND = 30
_SEE = any_of("参考", "看", "见")
_MEDIUM = any_of("图片", "视频", "图")
_STEP_MEDIA = any_of(any_of(*"主要 具体 详情 请".split()) + ".{0,6}" + _SEE + ".{0,4}" + _MEDIUM, any_of(*"调法 步骤 做法".split()) + ".{0,6}" + _SEE + ".{0,4}" + _MEDIUM)
_FOOD_MEDIA = any_of(*"比例 用量 用料 食材 配料 材料".split()) + ".{0,4}" + _SEE + _MEDIUM
_ACTIONS = any_of(*(
    "调味 装盘 取出 冷藏 冷冻 冰箱 融化 预热 烧开 过滤 混合 去皮 去核 下锅 发酵 打发 打碎 "
    "切 洗 煮 炒 煎 炸 蒸 烤 炖 焖 拌 加 放 倒 搅 揉 腌 泡 磨 压 擀 包 卷 撒 淋 铺 抹 涂 摆 塞 挤 蘸 兑 冲 捞 沥 熬 焯 汆 烫"
).split()[::-1])
_HEATED = rf"(?Ud)[度℃°].{{0,8}}{_NUMBER}\s*(?:小时|分钟)"
_FILL = r"[\W_]*"
_EMPTY_FOOD = rf"(?U)\A{_FILL}" + any_of(*"适量 少许 若干 随意 任意 看图 见图 如图 爱心 耐心 爱".split()) + rf"{_FILL}\z"
_EMPTY_STEP = rf"(?iuU)\A{_FILL}" + any_of(
    r"\d+", r"[看见]图(?:[一二三]|\d+)?", *"如图 图片整理 传图专用 求关注 待更新 下次补上 看视频 见视频 见上文 见文字 详细步骤和用料看下面".split(),
    "记录(?:我做的)?(?:美食|家常菜)?", "步骤忘记[拍写]了?(?:下次补上)?", "忘记[拍写]步骤了?", "图片都有详细说法啦?", *"好吃 美味 完成 一次成功 成功 可爱 开吃".split(),
) + rf"{_FILL}\z"
_BARE_UNIT = rf"^{UNITS}(?=[一-鿿A-Za-z])"


_DIGITS = "".join(chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd")


def _value(c: Column) -> Column:
    """The number of a text of digits of any script; null where it is no number all the same."""
    return F.translate(c, _DIGITS, "".join(str(unicodedata.digit(d)) for d in _DIGITS)).try_cast("double")


def _numbers(text: Column, pattern: str) -> Column:
    """The matches of a pattern with a number as its first group: whole and value."""
    p = F.lit(pattern)
    return F.transform(F.arrays_zip(F.regexp_extract_all(text, p, 0).alias("w"), F.regexp_extract_all(text, p, 1).alias("v")), lambda z: F.struct(z["w"].alias("whole"), _value(z["v"]).alias("value")))


def _found(code: str, detail) -> Column:
    return F.struct(F.lit(code).alias("code"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))


_KIND = "array<struct<code: string, detail: string>>"


def over(text: Column, pattern: str, limit: float, label: str, code: str) -> Column:
    hits = F.filter(_numbers(text, pattern), lambda m: m["value"] > limit)
    return F.transform(hits, lambda m: _found(code, F.concat(F.lit(label), m["whole"]))).cast(_KIND)


def durations(text: Column, title: Column) -> Column:
    """Implausible durations. Near words of slow processes, or with such a title, more is plausible,
    and the age of poultry is none."""
    p = F.lit(_DURATION)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    pieces, whole = F.split(text, _DURATION, -1), F.regexp_extract_all(text, p, 0)
    matches = F.transform(
        F.arrays_zip(whole.alias("w"), F.regexp_extract_all(text, p, 1).alias("v"), F.regexp_extract_all(text, p, 2).alias("u")),
        lambda z, i: F.struct(z["w"].alias("whole"), _value(z["v"]).alias("value"), z["u"].alias("unit"), (total(F.slice(pieces, 1, i + 1)) + total(F.slice(whole, 1, i))).alias("start")),
    )

    def located(m: Column) -> Column:
        first = F.greatest(m["start"] - _AROUND, F.lit(0))
        context = F.substring(text, first + 1, m["start"] + F.length(m["whole"]) + _AROUND - first)
        return F.struct(m["whole"].alias("whole"), m["value"].alias("value"), m["unit"].alias("unit"), context.alias("context"))

    def implausible(m: Column) -> Column:
        slow = m["context"].rlike(_SLOW) | title.rlike(_SLOW_TITLE)
        limit = F.lit(None).cast("int")
        for unit, (usual, long) in _LIMITS.items():
            limit = F.when(m["unit"] == unit, F.when(slow, long).otherwise(usual)).otherwise(limit)
        aged = (m["unit"] == "天") & F.regexp_like(m["context"], F.concat(F.lit(r"(?U)\Q"), m["whole"], F.lit(r"\E" + _POULTRY)))
        return ~aged & (m["value"] > limit)

    hits = F.filter(F.transform(matches, located), implausible)
    return F.transform(hits, lambda m: _found("duration", F.concat(F.lit("可疑时长："), m["whole"]))).cast(_KIND)


def _of_text(text: Column, name: str, title: Column) -> Column:
    steps, food = name == "recipeInstructions", name == "recipeIngredient"
    parts = [
        _when(F.contains(text, F.lit("�")), _found("mojibake", "包含乱码替换字符"), _KIND),
        _when(text.rlike(f"(?iuU){CONTACT}"), _found("contact_info", "疑似包含联系方式"), _KIND),
        _when(text.rlike(r"(?iu)https?://|www\."), _found("external_link", "清理后仍包含外部链接"), _KIND),
    ]
    if steps:
        parts.append(_when(text.rlike(f"(?d){_STEP_MEDIA}"), _found("media_reference", "关键操作仍依赖缺失的图片或视频"), _KIND))
    if food:
        parts.append(_when(text.rlike(f"(?d){_FOOD_MEDIA}"), _found("media_reference", "食材或用量仍依赖缺失的图片或视频"), _KIND))
    if steps or name == "description":
        parts += [over(text, _CELSIUS, 350, "可疑摄氏温度：", "temperature"), over(text, _DEGREES, 500, "可疑温度：", "temperature")]
    if steps:
        parts.append(durations(text, title))
    if food:
        parts.append(over(text, _AMOUNT, 0, "可疑用量：", "amount"))
    return F.transform(F.concat(*parts), lambda f: F.struct(f["code"].alias("code"), F.lit(name).alias("field"), f["detail"].alias("detail"))).cast(FLAG)


def text_flags() -> Column:
    """The flags of the single texts of a record; each code and detail once, where it is first met."""
    title = F.col("name")
    parts = [_of_text(F.col(n), n, title) for n in ("name", "dish", "description")]
    parts.append(F.flatten(F.transform("recipeIngredient", lambda x: _of_text(x, "recipeIngredient", title))))
    parts.append(F.flatten(F.transform("recipeInstructions", lambda x: _of_text(x, "recipeInstructions", title))))
    return F.concat(*parts)


def _distinct(flags: Column) -> Column:
    sign = lambda f: F.concat(f["code"], F.lit("\x01"), f["detail"])
    return F.filter(flags, lambda f, i: F.array_position(F.transform(flags, sign), sign(f)) == i + 1)


def anomalies(cleaned: DataFrame) -> DataFrame:
    """cleaned (see recipe.cleaned) with its flags extended, and the training `output`."""
    food, steps = F.col("recipeIngredient"), F.col("recipeInstructions")
    df = cleaned.withColumn("output", output_text(F.col("description"), food, steps))
    df = df.withColumn("_texts", text_flags()).withColumn("_texts", _distinct(F.col("_texts")))
    df = df.withColumns({
        "_length": F.length("output"), "_food": plain_length(F.array_join(food, "")), "_step": plain_length(F.array_join(steps, "")),
        "_useful": F.filter(steps, lambda x: ~x.rlike(_EMPTY_STEP)), "_bare": F.size(F.filter(food, lambda x: x.rlike(_BARE_UNIT))),
    })
    useful, length, size = F.col("_useful"), F.col("_length"), F.size("_useful")
    kinds = F.size(F.array_distinct(F.transform(useful, lambda x: F.lower(plain(x)))))
    acts = F.exists(useful, lambda x: x.rlike(_ACTIONS) | x.rlike(_HEATED))
    reasons = F.array_compact(F.array(
        F.when(length < LEAST, "输出过短"), F.when((F.col("_food") < 2) & (F.col("_step") < 20), "食材和步骤信息均不足"), F.when(F.col("_step") < 8, "步骤有效字符过少"),
        F.when(F.forall(food, lambda x: x.rlike(_EMPTY_FOOD)), "食材只有占位内容"), F.when(size == 0, "没有可执行步骤"),
        F.when((size >= 4) & (kinds <= F.greatest(F.lit(1), F.floor(size / 4))), "步骤高度重复"),
        F.when(~acts & (F.aggregate(useful, F.lit(0), lambda a, x: a + F.length(x)) < 30), "简短步骤缺少烹饪动作"),
    ))
    df = df.withColumn("_reasons", reasons)
    text = lambda c: c.cast("string")
    detail = F.concat(F.lit("有效信息不足（"), F.array_join("_reasons", "、"), F.lit("）：输出 "), text(length), F.lit(" 字符，食材有效字符 "), text(F.col("_food")), F.lit("，步骤有效字符 "), text(F.col("_step")))
    bare = F.col("_bare")
    flags = F.concat(
        F.col("flags"),
        _when(is_generic_title(F.col("name")), _flag("generic_title", "name", "菜名是传图、记录、作品集或打卡类占位标题"), FLAG),
        F.col("_texts"),
        _when(length > MOST, _flag("overlong_recipe", "output", F.concat(F.lit("输出长度 "), text(length), F.lit(f" 字符，超过 {MOST}"))), FLAG),
        _when(F.size("_reasons") > 0, _flag("low_information", "output", detail), FLAG),
        _when((bare > 0) & (bare * 2 >= F.size(food)), _flag("malformed_ingredients", "recipeIngredient", F.concat(text(bare), F.lit("/"), text(F.size(food)), F.lit(" 条食材疑似缺少数量"))), FLAG),
    )
    return df.withColumn("flags", F.when(F.col("object"), flags).otherwise(F.col("flags"))).drop("_texts", "_length", "_food", "_step", "_useful", "_bare", "_reasons")
