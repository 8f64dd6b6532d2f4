"""Mining of a sample: rules for misspelt terms, and words that rules must spare."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import UNKNOWN, any_of
from millrace.operators import base_rules
from millrace.operators.rules import Rule, _quoted

_BEFORE = (
    "一小把 一大把 一小块 一小撮 半汤匙 一点点 适量 少量 少许 一些 若干 大约 半根 半个 半颗 一碗 一勺 一匙 半勺 大匙 小匙 汤匙 茶匙 大勺 小勺 瓶盖 千克 公斤 毫升 "
    "约 瓶 罐 克 斤 两 升 个 只 片 根 颗 粒 块 杯 勺 瓣 条 朵 头 枚 份 盒 把"
).split()
_NO_TERM = set("可不 根据 喜欢 需要 材料 做法 备用 切成 加入".split())
_NO_FOOD = "锅 主锅 高压锅 面包机 烤箱 烤盘 模具 容器 工具 包装 保鲜膜 锡纸 油纸 厨房纸 步骤 图片 视频".split()
_VAGUE = "适量 少量 少许 若干 多一些 看量 据个人量 据食量口味自定义 自己看着办 用量勺 小料 材料 馅儿料 镜面用".split()
_COUNT = "^[一二两三四五六七八九十半几]+[小大整]?" + any_of("汤匙", "茶匙", *"个只片根颗粒块杯碗勺匙撮瓣条朵头枚份盒把")
_MEASURE_END = "半?[个只片根颗粒块杯勺匙瓣条朵头枚份盒把]$"
_ASIDE_END = any_of(*"备用 可选 装饰用 若干 少许 少量 适量".split()) + "$"


def variants(term: str, confused: Mapping) -> set[str]:
    """The term with one character replaced by one it is mistaken for."""
    return {term[:i] + wrong + term[i + 1 :] for i, c in enumerate(term) for wrong in confused.get(c, ())}


def _prefix_order() -> list[str]:
    """Prefixes that begin like another one must keep their order; no shorter one comes first."""
    return sorted(_BEFORE, key=lambda p: -len(p))


def ingredient_terms(text: Column) -> Column:
    """The distinct terms in the text of an ingredient: runs of 2 to 12 Chinese characters without
    amounts, measures and asides. A heading in brackets has none."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}]{2,12}"), 0)
    strip = f"^(?:{any_of(*_prefix_order())}(?=.))+"

    def term(x: Column) -> Column:
        x = F.regexp_replace(x, _COUNT, "")
        x = F.regexp_replace(F.regexp_replace(x, _MEASURE_END, ""), _ASIDE_END, "")
        return F.regexp_replace(x, strip, "")

    def kept(x: Column) -> Column:
        return F.length(x).between(2, 6) & ~x.isin(*_VAGUE, *_NO_FOOD) & ~x.endswith("用") & ~x.rlike(any_of(*sorted(_NO_TERM)))

    found = F.array_distinct(F.filter(F.transform(runs, term), kept))
    return F.when(text.rlike(r"(?U)\A\s*【[^】]+】\s*\z"), F.array().cast("array<string>")).otherwise(found)


def texts_of(name: str) -> Column:
    """The texts of a field, be it one text or a list."""
    return F.col(name) if name in ("recipeIngredient", "recipeInstructions") else F.array(name)


def occurrences(sample: DataFrame, searched: list[tuple[str, list[str]]]) -> list[int]:
    """How often each (text, fields) occurs, overlaps not counted: one pass, one aggregate for each."""
    count = lambda t, f: F.aggregate(texts_of(f), F.lit(0).cast("long"), lambda a, x: a + F.regexp_count(x, F.lit(_quoted(t))))
    sums = [F.coalesce(F.sum(sum((count(t, f) for f in fields), F.lit(0))), F.lit(0)) for t, fields in searched]
    return list(sample.agg(*[s.alias(f"n{i}") for i, s in enumerate(sums)]).first()) if sums else []


def auto_id(wrong: str, right: str) -> str:
    return "auto_" + hashlib.blake2b(f"{wrong}>{right}".encode(), digest_size=4).hexdigest()


def mined_rules(sample: DataFrame, base: list[Rule] | None = None, terms: dict[str, list[str]] | None = None, confused: dict[str, list[str]] | None = None, least: int = 3) -> tuple[list[Rule], list[dict], set[str]]:
    """(rules, candidates, variants found). A variant becomes a rule if it occurs at least `least` times
    and no base rule has it; base rules come first."""
    base = list(base_rules.TYPOS) if base is None else base
    terms = {t: base_rules.TERMS[t] for t in base_rules.TERM_ORDER} if terms is None else terms
    confused = base_rules.CONFUSED if confused is None else confused
    known = {r.pattern for r in base if r.literal}
    tried = [(v, t, f) for t, f in terms.items() for v in sorted(variants(t, confused))]
    found, new = [], []
    for (wrong, right, where), n in zip(tried, occurrences(sample, [(v, f) for v, _, f in tried])):
        if n:
            promoted = n >= least and wrong not in known
            found.append({"variant": wrong, "replacement": right, "fields": where, "sample_count": n, "already_in_base": wrong in known, "promoted": promoted})
            if promoted:
                new.append(Rule(auto_id(wrong, right), frozenset(where), wrong, right, f"随机样本中出现 {n} 次；由标准烹饪词和易混字映射生成"))
    return base + new, found, {f["variant"] for f in found}


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, dish, ingredient): in how many records a dish is called so, and in how many ingredients
    the term occurs."""
    dish = F.trim(F.regexp_replace("dish", r"(?U)\s+", " "))
    dishes = sample.select(dish.alias("term"), F.lit("dish").alias("source")).where(~F.lower("term").isin(*UNKNOWN) & F.length("term").between(2, 12))
    foods = sample.select(F.explode("recipeIngredient").alias("x")).select(F.explode(ingredient_terms(F.col("x"))).alias("term"), F.lit("ingredient").alias("source"))
    is_ = lambda s: F.count_if(F.col("source") == s)
    return dishes.unionAll(foods).groupBy("term").agg(is_("dish").alias("dish"), is_("ingredient").alias("ingredient"))


def mined_words(sample: DataFrame, base: list[str] | None = None, excluded: set[str] = frozenset(), least_dish: int = 10, least_ingredient: int = 30) -> tuple[list[str], list[dict]]:
    """(words, candidates): the base words, then frequent terms that contain no excluded text, the most
    frequent first."""
    base = list(base_rules.PROTECTED) if base is None else base
    counts = term_counts(sample).where((F.col("dish") >= least_dish) | (F.col("ingredient") >= least_ingredient))
    if base:
        counts = counts.where(~F.col("term").isin(base))
    if excluded:
        counts = counts.where(~F.col("term").rlike(any_of(*map(_quoted, sorted(excluded)))))
    rows = counts.orderBy(F.desc(F.col("dish") + F.col("ingredient")), F.desc("term")).collect()
    found = []
    for r in rows:
        by = {s: r[s] for s in ("dish", "ingredient") if r[s]}
        found.append({"term": r.term, "sample_count": r.dish + r.ingredient, "source_counts": by, "sources": sorted(by)})
    return list(dict.fromkeys(base + [f["term"] for f in found])), found
