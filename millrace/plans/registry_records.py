"""Queries over records: mining, normal forms, states of runs, and the details of flags and changes."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from millrace.functions.text import kept_lines, nfc
from millrace.operators import mining
from millrace.operators.diagnosis import diagnosed, state
from millrace.operators.recipe import Rulebook
from millrace.plans.recipes import cleaning
from millrace.plans.registry import _recipe, _table, _values, query
from millrace.session import prepared

#: Ingredients by id and the term in each, and dishes.
_FOOD = (("五花肉500克", "五花肉"), ("两勺蚝油", "蚝油"), ("少许盐巴", "盐巴"), ("一小把香菜", "香菜"), ("高压锅", None))
_DISHES = ("红烧肉", "蚝油生菜", "unknown", "五花肉", "汤")
_SAMPLE = (
    f"WITH d AS (SELECT doc_id, [{', '.join(repr(d) for d in _DISHES)}][doc_id % 5 + 1] AS dish FROM documents), "
    f"i AS (SELECT doc_id, [{', '.join('NULL' if t is None else repr(t) for _, t in _FOOD)}][(doc_id + k) % 5 + 1] AS term FROM documents, (SELECT unnest([0, 2, 5]) AS k)), "
    "t AS (SELECT dish AS term, 1 AS d, 0 AS i FROM d WHERE dish <> 'unknown' AND length(dish) >= 2 UNION ALL SELECT term, 0, 1 FROM i WHERE term IS NOT NULL), "
    "c AS (SELECT term, sum(d)::BIGINT AS dish, sum(i)::BIGINT AS ingredient FROM t GROUP BY term)"
)


def _sample(spark, sf_dir) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    food = F.array(*[F.lit(f) for f, _ in _FOOD])
    pick = lambda k: F.element_at(food, (F.expr(f"(doc_id + {k}) % 5 + 1")).cast("int"))
    dish = F.element_at(F.array(*[F.lit(x) for x in _DISHES]), F.expr("doc_id % 5 + 1").cast("int"))
    steps = F.array(F.lit("绰水后绰水"), F.when(F.expr("doc_id % 3 = 0"), "切快下锅").otherwise("搅拌"))
    return d.select(dish.alias("dish"), F.lit("").alias("name"), F.lit("").alias("description"), F.array(pick(0), pick(2), pick(5)).alias("recipeIngredient"), steps.alias("recipeInstructions"))


@query(_SAMPLE + " SELECT term, dish, ingredient FROM c")
def term_counts(spark, sf_dir):
    """Terms by where they are from; a term counts once for each ingredient."""
    return mining.term_counts(_sample(spark, sf_dir))


@query(_SAMPLE + """, f AS (SELECT term, dish + ingredient AS n FROM c WHERE (dish >= 20 OR ingredient >= 30) AND term <> '盐巴' AND NOT contains(term, '蚝')),
    w AS (SELECT '盐巴' AS word, 0 AS part, 0 AS n UNION ALL SELECT term, 1, n FROM f) SELECT row_number() OVER (ORDER BY part, n DESC, word DESC) AS place, word FROM w""")
def mined_words(spark, sf_dir):
    """Base words, then frequent terms that are none of them and hold no excluded text, the most frequent first."""
    words, _ = mining.mined_words(_sample(spark, sf_dir), ["盐巴"], {"蚝"}, 20, 30)
    return spark.createDataFrame(list(enumerate(words, 1)), "place long, word string")


@query("""
    WITH n AS (SELECT count(*) AS all_, count(*) FILTER (doc_id % 3 = 0) AS third FROM documents)
    SELECT '绰水' AS variant, '焯水' AS replacement, 2 * all_ AS n, true AS promoted FROM n UNION ALL SELECT '切快', '切块', third, third >= 100 FROM n""")
def mined_rules(spark, sf_dir):
    """Misspelt terms of a sample and how often they occur; frequent ones become rules after the base ones."""
    rules, found, _ = mining.mined_rules(_sample(spark, sf_dir), [], least=100)
    assert {r.pattern for r in rules} == {f["variant"] for f in found if f["promoted"]}
    return spark.createDataFrame([(f["variant"], f["replacement"], f["sample_count"], f["promoted"]) for f in found], "variant string, replacement string, n long, promoted boolean")


_ODD = "\r\nCafe\u0301\u200b \u0007\u00a0au\t lait\r\r  \u00a0\rend\u3000x\u200d"


@query("""
    WITH t AS (SELECT doc_id, nfc_normalize(substr(text, 1, 60) || chr(13) || chr(10) || 'Cafe' || chr(769) || chr(8203) || ' ' || chr(7) || chr(160) || 'au' || chr(9) || ' lait' || chr(13) || chr(13) || '  ' || chr(160) || chr(13) || 'end' || chr(12288) || 'x' || chr(8205)) AS s FROM documents),
    l AS (SELECT doc_id, string_split(replace(replace(replace(replace(replace(s, chr(8203), ''), chr(7), ''), chr(160), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM t)
    SELECT doc_id, array_to_string(list_filter(list_transform(lines, lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM l""")
def normalize_controls(spark, sf_dir):
    """Composition, no-break spaces, carriage returns and control characters, of which every row has some."""
    text = F.concat(F.substring("text", 1, 60), F.lit(_ODD))
    return _table(spark, sf_dir, "documents").select("doc_id", kept_lines(nfc(text)).alias("text"))


_STATES = (None, "RUNNING", "COMPLETED", "FAILED", "UNKNOWN")


@query("""
    SELECT recorded, alive, broken, ended, CASE WHEN recorded = 'RUNNING' AND NOT alive THEN 'UNEXPECTED_STOP' WHEN recorded IN ('COMPLETED', 'FAILED') THEN recorded WHEN alive THEN 'RUNNING' WHEN broken THEN 'FAILED' WHEN ended THEN 'COMPLETED' ELSE 'UNKNOWN' END AS state
    FROM (VALUES (NULL), ('RUNNING'), ('COMPLETED'), ('FAILED'), ('UNKNOWN')) r(recorded), (VALUES (true), (false)) a(alive), (VALUES (true), (false)) b(broken), (VALUES (true), (false)) e(ended)""")
def run_states(spark, sf_dir):
    """The state of a run for everything its record, its process and its log may say."""
    every = itertools.product(_STATES, (True, False), (True, False), (True, False))
    return spark.createDataFrame([(r, a, b, e, state(r, a, "x" if b else None, e)) for r, a, b, e in every], "recorded string, alive boolean, broken boolean, ended boolean, state string")


@query("""SELECT doc_id, least(doc_id, 100) AS percent, doc_id * 99999999 AS step, 99999999999 AS total FROM documents""")
def log_progress(spark, sf_dir):
    """The last of several progress bars, with numbers beyond 32 bits."""
    bar = lambda p, s: F.format_string("%3d%%|##  | %d/%d [00:01", p, s, F.lit(99999999999))
    text = F.concat(bar(F.lit(1), F.lit(2).cast("long")), F.lit("\rnoise 3/4\n"), bar(F.least("doc_id", F.lit(100)), F.col("doc_id") * 99999999), F.lit("\nend"))
    df = diagnosed(_table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    return df.select("doc_id", *[F.element_at("progress", i + 1).cast("long").alias(n) for i, n in enumerate(("percent", "step", "total"))])


def _steps(*steps, **own):
    return _recipe(recipeInstructions=list(steps), **own)


_USUAL = ("把五花肉洗净切块焯水", "加入冰糖炒出糖色", "加水炖四十分钟即可装盘")
_TINY = {"name": "水", "dish": "水", "description": "", "recipeIngredient": ["水"]}
#: A line; the code, field and detail of each flag; and rule, field and count of each change; in their order.
DETAILS = [
    (_steps("烤箱预热400℃然后烤熟", "600度再烤一会儿", "12345度"), "temperature/recipeInstructions/可疑摄氏温度：400℃;temperature/recipeInstructions/可疑温度：600度;temperature/recipeInstructions/可疑温度：2345度", ""),
    (_steps("烤箱预热٤٠٠℃然后烤熟后装盘", "５００分钟"), "temperature/recipeInstructions/可疑摄氏温度：٤٠٠℃", ""),
    (_steps("把牛肉放进锅里炖200小时", "再炖2000分钟"), "duration/recipeInstructions/可疑时长：200小时;duration/recipeInstructions/可疑时长：2000分钟", ""),
    (_recipe(recipeIngredient=["50000克面粉", "٥٠٠٠٠克糖", "50000gx"]), "amount/recipeIngredient/可疑用量：50000克;amount/recipeIngredient/可疑用量：٥٠٠٠٠克", ""),
    (_recipe(recipeIngredient=["克面粉", "盐"]), "malformed_ingredients/recipeIngredient/1/2 条食材疑似缺少数量", ""),
    (_recipe(**_TINY, recipeInstructions=["好吃"]), "low_information/output/有效信息不足（输出过短、食材和步骤信息均不足、步骤有效字符过少、没有可执行步骤、简短步骤缺少烹饪动作）：输出 20 字符，食材有效字符 1，步骤有效字符 2", ""),
    (_steps("切一下", "切一下", "切一下", "切一下", "切一下"), "low_information/output/有效信息不足（步骤高度重复）：输出 76 字符，食材有效字符 14，步骤有效字符 15", ""),
    (_recipe(recipeIngredient=["适量", "少许"]), "low_information/output/有效信息不足（食材只有占位内容）：输出 69 字符，食材有效字符 4，步骤有效字符 29", ""),
    (_steps("漠过肉", "沫过肉", "淹制后侵泡", "寖泡切块下锅煮熟装盘", "抄水抄水"), "", "typo_chao_shui/recipeInstructions/2;typo_jin_pao_qin/recipeInstructions/1;typo_jin_pao_shen/recipeInstructions/1;typo_mo_guo/recipeInstructions/1;typo_mo_guo_foam/recipeInstructions/1;typo_yan_zhi/recipeInstructions/1"),
    (_recipe(dish="见 https://a.b"), "external_link/dish/清理后仍包含外部链接", ""),
    (_recipe(dish="公众号：abcde12345"), "contact_info/dish/疑似包含联系方式", ""),
    (_recipe(name="乱码�肉"), "mojibake/name/包含乱码替换字符", ""),
    (_recipe(name="我的作品集", dish="打卡"), "generic_title/name/菜名是传图、记录、作品集或打卡类占位标题", ""),
    (_recipe(recipeIngredient=["克糖8", "个鸡蛋2", "五花肉500克"]), "", "repair_ingredient_order/recipeIngredient/1;repair_ingredient_order/recipeIngredient/1"),
]


@query(_values([(i, f, c) for i, (_, f, c) in enumerate(DETAILS, 1)], "line, flags, changes"))
def case_details(spark, sf_dir):
    """Code, field and detail of flags in their order, and rule, field and count of changes, by hand."""
    df = prepared(spark).createDataFrame([("cases", i, v) for i, (v, *_) in enumerate(DETAILS, 1)], "path string, line long, value string")
    df = cleaning(df, Rulebook())
    flags = F.array_join(F.transform("flags", lambda f: F.concat_ws("/", f["code"], f["field"], f["detail"])), ";")
    changes = F.array_join(F.sort_array(F.transform("changes", lambda c: F.concat_ws("/", c["rule"], c["field"], c["count"].cast("string")))), ";")
    return df.select("line", flags.alias("flags"), changes.alias("changes"))
