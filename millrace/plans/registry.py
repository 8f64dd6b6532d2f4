"""Queries over the driver's tables, with the SQL that must give the same rows.

The tables hold no recipes, so documents stand in for records: the lines of a text are the items of
lists, its first line is the title. What needs Chinese text runs over small inline tables.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.functions.hashing import PROMPTS, content_key, prompt
from millrace.functions.text import kept_lines, normalized, plain_length
from millrace.functions.variant import is_object, records, strict_json, text_field
from millrace.operators import audit, base_rules, mining, ranking, sampling
from millrace.operators.diagnosis import diagnosed
from millrace.operators.recipe import Rulebook, converted, output_text, repaired_order
from millrace.operators.route import deduplicated, first_of, routed
from millrace.operators.rules import Compiled, Rule
from millrace.plans.recipes import cleaning
from millrace.session import prepared

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SEED, SIZE, POPULATION = 20260811, 100, 1000


def query(sql: str | None = None):
    """Registers a query by its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows, names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + f") AS t({names})"


_LINES = "list_filter(list_transform(string_split(replace(text, chr(160), ' '), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> '')"
_NORMAL = f"array_to_string({_LINES}, chr(10))"


def _lines_of(c: Column) -> Column:
    return F.filter(F.split(kept_lines(c), "\n"), lambda x: x != "")


@query(f"SELECT doc_id, {_NORMAL} AS text FROM documents")
def normalize_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text"), lines=True).alias("text"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def normalize_one_line(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text")).alias("text"))


@query(f"SELECT doc_id, h, n_chars FROM (SELECT doc_id, n_chars, sha256({_NORMAL}) AS h, row_number() OVER (PARTITION BY sha256({_NORMAL}) ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1")
def exact_dedup_first(spark, sf_dir):
    """Of documents with the same normalised text the first stays: one shuffle, of keys and ids only."""
    keyed = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2(kept_lines(F.col("text")), 256).alias("h"))
    return first_of(keyed, ["h"], ["doc_id"]).where("nth = 1").select("doc_id", "h", "n_chars")


def _stand_ins(spark, sf_dir) -> DataFrame:
    """Documents as cleaned records: flags for short and long texts, repeated lines and addresses. One
    that is too short lacks its steps, so that it is a structural failure."""
    df = _table(spark, sf_dir, "documents").withColumn("lines", _lines_of(F.col("text")))
    n = F.size("lines")
    flag = lambda code, cond: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit("text").alias("field"), F.col("n_chars").cast("string").alias("detail")))
    per_line = F.transform(F.filter("lines", lambda x: F.contains(x, F.lit("@"))), lambda x: F.struct(F.lit("address").alias("code"), F.lit("text").alias("field"), F.length(x).cast("string").alias("detail")))
    flags = F.concat(F.array_compact(F.array(
        flag("missing_instructions", F.length("text") < 35), flag("overlong", F.length("text") > 8000),
        flag("repeated", (n >= 4) & (F.size(F.array_distinct("lines")) <= F.greatest(F.lit(1), F.floor(n / 4)))),
    )), per_line)
    df = df.withColumn("flags", flags)
    change = F.transform(F.filter("flags", lambda f: f["code"] == "address"), lambda f: F.struct(F.lit("hide_address").alias("rule"), f["field"].alias("field"), f["detail"].cast("int").alias("count"), F.lit("").alias("reason")))
    return df.select("doc_id", F.lit("documents").alias("path"), F.col("doc_id").alias("line"), F.lit(True).alias("valid"), F.lit(True).alias("object"), F.get("lines", F.lit(0)).alias("name"), F.col("lines").alias("recipeIngredient"), F.col("lines").alias("recipeInstructions"), "flags", change.alias("changes"))


_FLAGS = f"""
    l AS (SELECT doc_id, text, n_chars, {_LINES} AS lines FROM documents),
    f AS (
        SELECT doc_id, 0 AS pos, 'missing_instructions' AS code, n_chars::VARCHAR AS detail FROM l WHERE length(text) < 35
        UNION ALL SELECT doc_id, 1, 'overlong', n_chars::VARCHAR FROM l WHERE length(text) > 8000
        UNION ALL SELECT doc_id, 2, 'repeated', n_chars::VARCHAR FROM l WHERE len(lines) >= 4 AND len(list_distinct(lines)) <= greatest(1, len(lines) // 4)
        UNION ALL SELECT doc_id, 3 + i, 'address', length(x)::VARCHAR FROM (SELECT doc_id, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM l) WHERE contains(x, '@'))"""


def _routed(spark, sf_dir) -> DataFrame:
    return deduplicated(routed(_stand_ins(spark, sf_dir)))


_ROUTES = f"""WITH {_FLAGS},
    r AS (SELECT doc_id, {_NORMAL} AS body, CASE WHEN doc_id IN (SELECT doc_id FROM f WHERE code = 'missing_instructions') THEN 'rejected' WHEN doc_id IN (SELECT doc_id FROM f) THEN 'review' ELSE 'clean' END AS route FROM documents),
    d AS (SELECT doc_id, CASE WHEN route = 'clean' AND row_number() OVER (PARTITION BY CASE WHEN route = 'clean' THEN body ELSE '#' || doc_id END ORDER BY doc_id) > 1 THEN 'duplicate' ELSE route END AS route FROM r)"""


@query(_ROUTES + " SELECT doc_id, route FROM d")
def routes(spark, sf_dir):
    return _routed(spark, sf_dir).select("doc_id", "route")


@query(_ROUTES + " SELECT count(*) AS read, count(*) FILTER (route = 'rejected') AS rejected, count(*) FILTER (route = 'review') AS review, count(*) FILTER (route = 'duplicate') AS duplicates, count(*) FILTER (route = 'clean') AS eligible FROM d")
def route_counts(spark, sf_dir):
    return audit.summary(_routed(spark, sf_dir))


@query(f"WITH {_FLAGS} SELECT code, count(DISTINCT doc_id) AS records, count(*) AS occurrences FROM f GROUP BY code")
def issue_record_vs_occurrence(spark, sf_dir):
    return audit.issue_counts(_stand_ins(spark, sf_dir))


@query(f"WITH {_FLAGS}, n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY doc_id, pos) AS nth FROM f) SELECT n.code, n.nth, n.doc_id AS line, l.lines[1] AS name, n.detail FROM n JOIN l USING (doc_id) WHERE nth <= 5")
def examples_per_issue(spark, sf_dir):
    return audit.issue_examples(_stand_ins(spark, sf_dir), 5)


@query(f"WITH {_FLAGS}, n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY doc_id, pos) AS nth FROM f WHERE code = 'address') SELECT 'hide_address' AS rule, n.nth, n.doc_id AS line, l.lines[1] AS name, 'text' AS field, n.detail::INT AS count FROM n JOIN l USING (doc_id) WHERE nth <= 5")
def rule_examples(spark, sf_dir):
    return audit.rule_examples(_stand_ins(spark, sf_dir), 5)


@query(f"WITH l AS (SELECT doc_id, {_LINES} AS lines FROM documents) SELECT doc_id, len(lines) AS n_lines, len(list_distinct(lines)) AS n_distinct FROM l WHERE len(lines) >= 4 AND len(list_distinct(lines)) <= greatest(1, len(lines) // 4)")
def repeated_lines(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").select("doc_id", _lines_of(F.col("text")).alias("lines"))
    df = df.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("lines")).cast("long").alias("n_distinct"))
    return df.where((F.col("n_lines") >= 4) & (F.col("n_distinct") <= F.greatest(F.lit(1), F.floor(F.col("n_lines") / 4))))


_URL = r"(?i)(?:https?://|www\.)[^；;，。\s]+"


@query(f"SELECT page_id, len(regexp_extract_all(html, '{_URL}')) AS n_urls, md5(regexp_replace(html, '{_URL}', '', 'g')) AS stripped FROM pages")
def url_strip_counts(spark, sf_dir):
    rule = next(r for r in base_rules.NOISE if r.id == "external_url")
    done = Compiled([rule]).apply(F.array("html"))[0]
    pages = _table(spark, sf_dir, "pages").select("page_id", done.alias("s"))
    return pages.select("page_id", F.element_at("s.counts", 1).cast("long").alias("n_urls"), F.md5("s.text").alias("stripped"))


_RULES = [Rule("long", frozenset({"text"}), "ing the ", "ing a ", "", True), Rule("digits", frozenset({"text"}), r"\d+", "#", "", False), Rule("the", frozenset({"text"}), "the", "THE", "", True)]


@query("""
    WITH a AS (SELECT doc_id, text, replace(text, 'ing the ', 'ing a ') AS t1 FROM documents),
    b AS (SELECT *, regexp_replace(t1, '[0-9]+', '#', 'g') AS t2 FROM a),
    c AS (SELECT *, replace(replace(t2, 'other', chr(1)), 'then', chr(2)) AS held FROM b),
    n AS (SELECT doc_id, (length(text) - length(t1)) // 2 AS n1, len(regexp_extract_all(t1, '[0-9]+')) AS n2, (length(held) - length(replace(held, 'the', ''))) // 3 AS n3 FROM c),
    u AS (SELECT doc_id, 'long' AS rule, n1 AS n FROM n UNION ALL SELECT doc_id, 'digits', n2 FROM n UNION ALL SELECT doc_id, 'the', n3 FROM n)
    SELECT rule, count(*) FILTER (n > 0) AS records, sum(n)::BIGINT AS applications FROM u WHERE n > 0 GROUP BY rule""")
def rule_accounting(spark, sf_dir):
    """Ordered rules, one of them guarded by protected words, and their counts by record and use."""
    book = Compiled(_RULES, ["other", "then"])
    df = _table(spark, sf_dir, "documents").select(book.apply(F.array("text"))[0].alias("s"))
    return audit.rule_counts(df.select(book.changes(F.col("s.counts"), "text").alias("changes")))


@query("""
    WITH h AS (SELECT doc_id, replace(replace(text, 'other', chr(1)), 'then', chr(2)) AS held FROM documents)
    SELECT doc_id, (length(held) - length(replace(held, 'the', ''))) // 3 AS n, md5(replace(replace(replace(held, 'the', 'THE'), chr(1), 'other'), chr(2), 'then')) AS replaced FROM h""")
def guarded_replace(spark, sf_dir):
    done = Compiled([_RULES[2]], ["other", "then"]).apply(F.array("text"))[0]
    df = _table(spark, sf_dir, "documents").select("doc_id", done.alias("s"))
    return df.select("doc_id", F.element_at("s.counts", 1).cast("long").alias("n"), F.md5("s.text").alias("replaced"))


@query("SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\\.[A-Za-z]+')")
def email_flag(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+")).select("doc_id", "n_chars")


@query("""SELECT quantile_cont(n_chars, 0.5)::DECIMAL(18,3) AS p50, quantile_cont(n_chars, 0.9)::DECIMAL(18,3) AS p90, quantile_cont(n_chars, 0.95)::DECIMAL(18,3) AS p95,
    quantile_cont(n_chars, 0.99)::DECIMAL(18,3) AS p99, quantile_cont(n_chars, 0.999)::DECIMAL(18,3) AS p999, avg((n_chars > 2048)::INT)::DECIMAL(9,6) AS over_share FROM documents""")
def length_percentiles(spark, sf_dir):
    return audit.length_profile(_table(spark, sf_dir, "documents"), "n_chars")


_PICKED = ", ".join(map(str, sampling.selection(POPULATION, SIZE, SEED)))


@query(f"SELECT doc_id, ordinal FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents) WHERE ordinal IN ({_PICKED})")
def seq_sample_exact(spark, sf_dir):
    """Selection sampling. The SQL lists the ordinals of a population of 1,000, the size at sf 0.01."""
    return sampling.sequential_sample(_table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SIZE, SEED)


_SLOTS = ", ".join(f"({o}, {i})" for i, o in enumerate(sampling.reservoir(POPULATION, SIZE, SEED)))


@query(f"SELECT doc_id, ordinal, slot FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents) JOIN (VALUES {_SLOTS}) AS s(o, slot) ON o = ordinal")
def reservoir_sample(spark, sf_dir):
    return sampling.reservoir_sample(_table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SIZE, SEED).select("doc_id", "ordinal", "slot")


@query(f"SELECT doc_id FROM documents ORDER BY md5('{SEED}|' || doc_id) LIMIT {SIZE}")
def hash_sample(spark, sf_dir):
    return sampling.hash_sample(_table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), SIZE, SEED)


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) >= 35 ORDER BY doc_id LIMIT 20")
def output_limit(spark, sf_dir):
    """Limits what is written, not what is read."""
    return _table(spark, sf_dir, "documents").where(F.length("text") >= 35).orderBy("doc_id").limit(20).select("doc_id", "n_chars")


@query("""
    SELECT u.conv_id, u.turn, u.text AS instruction, '' AS input, a.text AS output FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def train_format(spark, sf_dir):
    """Question and answer, the following turn: a window instead of a self-join."""
    by = W.partitionBy("conv_id").orderBy("turn")
    c = _table(spark, sf_dir, "conversations")
    c = c.withColumns({n: F.lead(m).over(by) for n, m in (("_role", "role"), ("_turn", "turn"), ("output", "text"))})
    c = c.where("role = 'user' AND _role = 'assistant' AND _turn = turn + 1")
    return c.select("conv_id", "turn", F.col("text").alias("instruction"), F.lit("").alias("input"), "output")


@query(f"""
    WITH l AS (SELECT doc_id, {_LINES} AS lines FROM documents)
    SELECT doc_id, '食材：' || chr(10) || array_to_string(list_transform(lines, lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) || '制作步骤：' || chr(10)
        || array_to_string(list_transform(lines, lambda x, i: i || '. ' || x), chr(10)) AS output FROM l""")
def format_output(spark, sf_dir):
    lines = _lines_of(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", output_text(F.lit(""), lines, lines).alias("output"))


_SEARCHED = ("the", "and", "ion", "anan", "que")


@query(" UNION ALL ".join(f"SELECT '{t}' AS variant, sum((length(text) - length(replace(text, '{t}', ''))) // {len(t)})::BIGINT AS n FROM documents" for t in _SEARCHED))
def variant_count(spark, sf_dir):
    """Occurrences of several texts in one scan, overlaps not counted."""
    df = _table(spark, sf_dir, "documents").select(F.array("text").alias("recipeIngredient"))
    n = mining.occurrences(df, [(t, ["recipeIngredient"]) for t in _SEARCHED])
    return spark.createDataFrame(list(zip(_SEARCHED, n)), "variant string, n long")


_TERMS = [(r, w) for r in base_rules.TERM_ORDER for w in sorted(mining.variants(r, base_rules.CONFUSED))]


@query(_values([("焯水", "抄水"), ("焯水", "绰水"), ("腌制", "奄制"), ("腌制", "淹制"), ("浸泡", "侵泡"), ("浸泡", "寖泡"), ("没过", "沫过"), ("没过", "漠过"), ("蚝油", "耗油"), ("鱼块", "鱼快"), ("切块", "切快"), ("浮沫", "浮末"), ("预热", "予热"), ("烤箱", "考箱"), ("搅拌", "绞拌"), ("沥干", "历干"), ("沥干", "利干")], "term, variant"))
def confusion_variants(spark, sf_dir):
    return spark.createDataFrame(_TERMS, "term string, variant string")


_FOODS = {"两个千克面粉适量": ["面粉"], "【主料】": [], "五花肉500克": ["五花肉"], "少许盐巴、生抽一勺": ["盐巴", "生抽一"], "装饰用": [], "半勺白砂糖备用": ["白砂糖"], "高压锅": [], "一小把香菜": ["香菜"]}


@query(_values([(k, ",".join(v)) for k, v in _FOODS.items()], "text, terms"))
def ingredient_terms(spark, sf_dir):
    df = spark.createDataFrame([(k,) for k in _FOODS], "text string")
    return df.select("text", F.array_join(mining.ingredient_terms(F.col("text")), ",").alias("terms"))


_ORDERS = {"克糖8": "8克糖", "个鸡蛋2": "2个鸡蛋", "一个个鸡蛋": "一个鸡蛋", "适量克盐": "适量盐", "面粉100克": "面粉100克", "勺生抽 半": "半勺生抽", "千克面粉：1.5": "1.5千克面粉", "三片片姜": "三片姜"}


@query(_values([(k, v, int(k != v)) for k, v in _ORDERS.items()], "text, repaired, changed"))
def ingredient_repair(spark, sf_dir):
    df = spark.createDataFrame([(k,) for k in _ORDERS], "text string").withColumn("repaired", repaired_order(F.col("text")))
    return df.withColumn("changed", (F.col("text") != F.col("repaired")).cast("int"))


@query("""
    SELECT event_id, json_type(props) AS kind, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN json_extract_string(props, '$.k') ELSE '' END AS k FROM events""")
def json_strict(spark, sf_dir):
    """JSON with its types: a number is no text."""
    e = _table(prepared(spark), sf_dir, "events").select("event_id", strict_json(F.col("props")).alias("v"))
    return e.select("event_id", F.when(is_object(F.col("v")), "OBJECT").alias("kind"), text_field(F.col("v"), "k").alias("k"))


_JSON = [('{"a":1}', 1, 1), ('{"a":1} x', 0, 0), ('{"a":1}]', 0, 0), ('{"a":1}}', 0, 0), ('{"a":1}{"b":2}', 0, 0), ('{"a":1},"b":2', 0, 0), ("{", 0, 0), ("[1]", 1, 0), ("null", 1, 0), ('"x"', 1, 0), ("", 0, 0), ('{"a":1,"a":2}', 1, 1), (' {"a" : [1, 2]} ', 1, 1), ("{'a':1}", 0, 0), ("01", 0, 0)]


@query(_values(_JSON, "value, valid, object"))
def json_lines(spark, sf_dir):
    df = records(prepared(spark).createDataFrame([(j,) for j, *_ in _JSON], "value string"))
    return df.select("value", F.col("valid").cast("int").alias("valid"), F.col("object").cast("int").alias("object"))


NATIONS = [f"NATION_{i}" for i in range(25)]


def _prompt(name: str) -> str:
    return PROMPTS[int.from_bytes(hashlib.blake2b(name.encode(), digest_size=2).digest(), "big") % len(PROMPTS)].format(name=name)


@query(f"SELECT n_name, prompt FROM nation JOIN ({_values([(n, _prompt(n)) for n in NATIONS], 'name, prompt')}) ON name = n_name")
def prompt_choice(spark, sf_dir):
    return _table(spark, sf_dir, "nation").where(F.col("n_name").isin(NATIONS)).select("n_name", prompt(F.col("n_name")).alias("prompt"))


@query(f"WITH l AS (SELECT doc_id, source, {_LINES} AS lines FROM documents) SELECT doc_id, sha256('[' || to_json(source) || ',' || to_json(lines) || ',' || to_json(lines[:2]) || ']') AS key FROM l")
def content_keys(spark, sf_dir):
    lines = _lines_of(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", content_key(F.col("source"), lines, F.slice(lines, 1, 2)).alias("key"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]')) AS n FROM documents")
def meaningful_chars(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", plain_length(F.col("text")).cast("long").alias("n"))


def _recipe(**own) -> str:
    base = {"name": "红烧肉", "dish": "红烧肉", "description": "家常菜", "recipeIngredient": ["500克五花肉", "盐少许", "生姜三片"], "recipeInstructions": ["把五花肉洗净切块焯水", "加入冰糖炒出糖色", "加水炖四十分钟即可装盘"]}
    return json.dumps(base | own, ensure_ascii=False)


#: A line, where it goes, its flags, and the rules that changed it.
CASES = [
    (_recipe(), "clean", "", ""),
    (_recipe(description="另一种说法"), "duplicate", "", ""),
    (_recipe(recipeIngredient=["克糖8", "个鸡蛋2", "看图花椒"]), "clean", "", "ingredient_media_deictic,repair_ingredient_order"),
    (_recipe(recipeIngredient=["材料见图", "500克牛肉"]), "review", "media_reference", "remove_ingredient_placeholder,trailing_media_reference"),
    (_recipe(recipeInstructions=["如图切块下锅煮熟", "看图", "把肉抄水后切块装盘"]), "clean", "", "inline_media_deictic,standalone_media_step,typo_chao_shui"),
    (_recipe(recipeInstructions=["看图", "见视频", "把肉焯水后切块装盘"]), "review", "media_dependent", "standalone_media_step"),
    (_recipe(recipeInstructions=["详见https://a.b/c，加糖搅拌均匀后下锅"]), "clean", "", "external_url"),
    (_recipe(recipeInstructions=["把牛肉放进锅里炖200小时"]), "review", "duration", ""),
    (_recipe(recipeInstructions=["把牛肉放进坛里腌200小时"]), "clean", "", ""),
    (_recipe(recipeInstructions=["选180天以上的鸡切块下锅炒熟"]), "clean", "", ""),
    (_recipe(recipeInstructions=["烤箱预热400℃然后烤熟", "600度再烤一会儿"]), "review", "temperature,temperature", ""),
    (_recipe(recipeInstructions=["烤箱预热180度然后烤熟", "放进-18℃冷冻"]), "clean", "", ""),
    (_recipe(recipeIngredient=["50000克面粉", "50000gx"]), "review", "amount", ""),
    (_recipe(name="传图专用"), "duplicate", "", "generic_title_dish_fallback"),
    (_recipe(name="我的作品集", dish="打卡"), "review", "generic_title", ""),
    (_recipe(name="很" * 61), "duplicate", "", "short_dish_name_fallback"),
    (_recipe(name="unknown", dish="null"), "rejected", "missing_name", ""),
    (_recipe(name="水", dish="水", description="", recipeIngredient=["水"], recipeInstructions=["好吃"]), "review", "low_information", ""),
    (_recipe(recipeIngredient=["克面粉", "盐"]), "review", "malformed_ingredients", ""),
    (_recipe(recipeInstructions=["切一下"] * 4), "review", "low_information", ""),
    (_recipe(recipeIngredient=[]), "rejected", "low_information,missing_ingredients", ""),
    (_recipe(recipeInstructions=12), "rejected", "low_information,missing_instructions", ""),
    (_recipe(description="好吃\n加我微信：abcde12345"), "duplicate", "", "contact_promotion_line"),
    (_recipe(description="#123\n关注我"), "duplicate", "", "promotion_line,standalone_post_number"),
    (_recipe(recipeInstructions=["加我vx：abcde12345后把肉切块下锅煮熟"]), "clean", "", "contact_identifier_in_step"),
    (_recipe(dish="公众号：abcde12345"), "review", "contact_info", ""),
    (_recipe(name="乱码�肉"), "review", "mojibake", ""),
    (_recipe(description="长" * 8001), "review", "overlong_recipe", ""),
    ('{"a":1} x', "rejected", "invalid_json", ""),
    ("[1]", "rejected", "not_object", ""),
]


@query(_values([(i, r, f, c) for i, (_, r, f, c) in enumerate(CASES, 1)], "line, route, flags, rules"))
def recipe_cases(spark, sf_dir):
    """Whole cleaning over a table with a row for each flag, rule and route."""
    df = prepared(spark).createDataFrame([("cases", i, v) for i, (v, *_) in enumerate(CASES, 1)], "path string, line long, value string")
    df = cleaning(df, Rulebook())
    listed = lambda c, k: F.array_join(F.sort_array(F.transform(c, lambda x: x[k])), ",")
    return df.select("line", "route", listed("flags", "code").alias("flags"), F.array_join(F.sort_array(F.array_distinct(F.transform("changes", lambda x: x["rule"]))), ",").alias("rules"))


_SIMPLE = [
    (_recipe(name="  红  烧肉 ", description=" 好 \n\n 吃 "), "红 烧肉", "简介：好\n吃\n\n食材：\n- 500克五花肉\n- 盐少许\n- 生姜三片\n\n制作步骤：\n1. 把五花肉洗净切块焯水\n2. 加入冰糖炒出糖色\n3. 加水炖四十分钟即可装盘"),
    (_recipe(name="无", description="", recipeIngredient="水", recipeInstructions=["煮 ", ""]), "红烧肉", "食材：\n- 水\n\n制作步骤：\n1. 煮"),
    (_recipe(name="", dish="unknown"), None, None), (_recipe(recipeInstructions=[]), None, None), ("[]", None, None), ("{", None, None),
]


@query(_values([(i, _prompt(n), "", o) for i, (_, n, o) in enumerate(_SIMPLE, 1) if n], "line, instruction, input, output"))
def simple_conversion(spark, sf_dir):
    df = prepared(spark).createDataFrame([("cases", i, v) for i, (v, *_) in enumerate(_SIMPLE, 1)], "path string, line long, value string")
    return converted(records(df)).select("line", "instruction", "input", "output")


_LOGS = [
    ("step\n 12%|##   | 5/40 [\n 25%|###  | 10/40 [\n{'loss': '1.5', 'grad_norm': '1', 'learning_rate': '1e-4', 'epoch': '0.5'}\n", "25,10,40", "1.5,1e-4,0.5", None, None),
    ("a\ntorch.OutOfMemoryError: CUDA out of memory. Tried\nKilled\n", None, None, "CUDA 显存溢出", "torch.OutOfMemoryError: CUDA out of memory. Tried"),
    ("Traceback (most recent call last)\n  File x\nValueError: bad\n", None, None, "Python 运行异常", "ValueError: bad"),
    ("OSError: No space left on device", None, None, "磁盘空间不足", "OSError: No space left on device"),
    ("fine\ntrain_runtime train_loss", None, None, None, None),
]


@query(_values([(i, *r[1:]) for i, r in enumerate(_LOGS)], "id, progress, metrics, category, detail"))
def log_diagnosis(spark, sf_dir):
    df = diagnosed(spark.createDataFrame([(i, r[0]) for i, r in enumerate(_LOGS)], "id int, text string"))
    return df.select("id", F.array_join(F.col("progress").cast("array<string>"), ",").alias("progress"), F.array_join("metrics", ",").alias("metrics"), "category", "detail")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN user_id ELSE 0 END::DOUBLE AS number FROM events")
def safe_floats(spark, sf_dir):
    """Numbers in several spellings, and what is none."""
    said = F.when(F.expr("event_id % 4 = 0"), F.col("value").cast("string")).when(F.expr("event_id % 4 = 1"), F.format_string(" %d ", F.col("user_id"))).when(F.expr("event_id % 4 = 2"), F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", ranking.safe_float(said).alias("number"))


from millrace.plans import registry_files, registry_records  # noqa: E402, F401 - they register further queries
