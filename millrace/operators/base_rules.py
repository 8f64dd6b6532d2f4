"""The rules and word lists that come with the engine, in the order in which they run."""

from __future__ import annotations

from millrace.functions.text import any_of
from millrace.operators.rules import Rule

_D, _I, _S = "description", "recipeIngredient", "recipeInstructions"

_LOOK = any_of("看", "见", "参考")
_PICTURE = any_of("图片", "图", "视频")
_WHICH = any_of("[一二三]", r"\d+") + "?"
_HANDS = r"[\x{1F446}\x{1F447}\x{1F449}\x{1F3FB}-\x{1F3FF}\s]*哈*[!！.。]?\s*$"
_ACCOUNT = any_of("微信公众号", "公众号", "个人微信", "微信", "新浪微博", "微博", "vx", "v信") + r"\s*[：:]?\s*[a-zA-Z_0-9@-]{5,}"
_SHOWN = any_of("如下图", "如图", "上图", "下图")

CONTACT = _ACCOUNT

_STEP_ONLY = any_of(
    f"请?{_LOOK}[上下]?{_PICTURE}{_WHICH}", "如图(?:所示)?", "按照图片操作", "按图操作", "图片整理", "传图专用", "见文字", "见上文",
    "图片都有详细说法啦?", "详细步骤和用料看下面", f"步骤忘记[拍写]了?(?:下次补上)?", f"忘记[拍写]步骤了?", "(?:直接来个)?成品图吧?", "过程没有录制",
)

#: Regular expressions, longer ones first.
NOISE = [
    Rule("standalone_media_step", frozenset({_S}), rf"^\s*{_STEP_ONLY}{_HANDS}", "", "删除完全依赖缺失图片的独立步骤", False),
    Rule("contact_promotion_line", frozenset({_D}), f"(?im)^.*{_ACCOUNT}.*$", "", "删除描述中包含联系方式的推广行", False),
    Rule("trailing_media_reference", frozenset({_D, _I, _S}), r"[;；，,。\s]*" + any_of("详情见视频", "点击视频查看", "如图所示", "如图", "见图", "看图") + _HANDS, "", "删除训练数据中无法访问的图片或视频引用", False),
    Rule("contact_identifier_in_step", frozenset({_S}), f"(?i){_ACCOUNT}", "", "删除制作步骤中的联系方式账号", False),
    Rule("inline_media_deictic", frozenset({_D, _I, _S}), f"[(（]?{_SHOWN}(?:所?示)?{_WHICH}[)）]?", "", "删除缺少图片上下文的指示词，同时保留可独立理解的操作文字", False),
    Rule("promotion_line", frozenset({_D}), "(?im)^.*" + any_of("关注公众号", "关注我", "私信我", "联系我", "加我", "不做免费的?咨询") + ".*$", "", "删除描述中的联系、关注和付费咨询推广行", False),
    Rule("ingredient_media_deictic", frozenset({_I}), f"[(（]?[见看]{any_of('图片', '图')}{_WHICH}[)）]?", "", "删除食材字段中无法提供用量信息的看图或见图指示词", False),
    Rule("external_url", frozenset({_D, _I, _S}), r"(?i)(?:https?://|www\.)[^；;，。\s]+", "", "删除训练时无法访问的外部链接", False),
    Rule("standalone_post_number", frozenset({_D}), r"(?m)^\s*#\d+\s*$", "", "删除原平台作品编号", False),
]

#: Literal corrections: id, wrong, right, reason, whether in descriptions too.
TYPOS = [
    Rule(f"typo_{name}", frozenset({_D, _S} if wide else {_S}), wrong, right, why)
    for name, wrong, right, why, wide in (
        ("mo_guo", "漠过", "没过", "烹饪语境中表示液面覆盖食材", True),
        ("mo_guo_foam", "沫过", "没过", "烹饪语境中表示液面覆盖食材", True),
        ("yan_zhi", "淹制", "腌制", "固定烹饪动词错字", True),
        ("jin_pao_qin", "侵泡", "浸泡", "固定烹饪动词错字", True),
        ("jin_pao_shen", "寖泡", "浸泡", "固定烹饪动词错字", True),
        ("chao_shui", "抄水", "焯水", "固定烹饪工序错字", False),
    )
]

PROTECTED = "布里欧修 中种 烫种 滩羊 红柿椒 圣女果".split()

#: Right terms whose misspellings are looked for, and the fields they are looked for in.
TERMS = {t: [_S] for t in "焯水 没过 切块 浮沫 预热 搅拌 沥干".split()} | {t: [_D, _S] for t in ("腌制", "浸泡")} | {t: [_I, _S] for t in ("鱼块", "烤箱")} | {"蚝油": [_I]}
TERM_ORDER = "腌制 浸泡 焯水 没过 蚝油 鱼块 切块 浮沫 预热 烤箱 搅拌 沥干".split()

#: Right character -> characters it is mistaken for.
CONFUSED = {right: list(wrong) for right, wrong in (x.split("/") for x in "腌/淹奄 浸/侵寖 焯/抄绰 没/漠沫 蚝/耗 块/快 沫/末 预/予 烤/考 搅/绞 沥/历利".split())}
