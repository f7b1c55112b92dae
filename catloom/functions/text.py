"""String predicates, formatting and catalog text cleaning (SCL-01 .. SCL-33)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import JavaPattern, col, cut_before, let, replace_all, trim_ws

# Digits outside the decimal class (superscripts, circled digits, ...), as a regex class body.
_OTHER_DIGITS = (
    r"\u00b2\u00b3\u00b9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089"
    r"\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff"
    r"\u2776-\u277e\u2780-\u2788\u278a-\u2792"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
_DIGIT = rf"\p{{Nd}}{_OTHER_DIGITS}"
_CHINESE = r"\u4e00-\u9fff"

# ---------------------------------------------------------------- fixed values

# Markup codes of captions, decoded when the text has a semicolon.
ENTITY_CODES = [
    ("&amp;", "&"), ("&AMP;", "&"), ("&nbsp;", " "), ("&NBSP;", " "),
    ("&gt;", ">"), ("&GT;", ">"), ("&raquo;", "?"),
]
# Percent and slash codes, always decoded, in this order.
URL_CODES = [("%3A", ":"), ("%3a", ":"), ("%20", " "), ("//", "/"), (":/", "://")]

# Category caption clean-up, in this order.
CATEGORY_REPLACEMENTS = [
    ("★", ""), ("☆", ""), ("专卖店", ""), ("专卖", ""), ("手机报价", ""), ("报价", ""),
    ("排序", ""), ("排列", ""), ("专区", ""), ("系列", ""), ("[", ""), ("]", ""), ("#", ""),
    ("　", " "), ("■", " "), ("·", " "), ("。", " "), ("．", " "), (".", " "), ("\\", "/"),
]

# Digits and formal numerals, and the numerals they become.
NUMERALS_FROM = "0123456789壹贰叁肆伍陆柒捌玖"
NUMERALS_TO = "零一二三四五六七八九一二三四五六七八九"

# Words dropped or shortened before names are compared, in this order.
COMPARE_REPLACEMENTS = [
    ("品牌", ""), ("用品", ""), ("产品", ""), ("商品", ""), ("所有", ""), ("全部", ""), ("最新", ""),
    ("包装", ""), ("生活", ""), ("限时", ""), ("抢购", ""), ("优惠", ""), ("促销", ""), ("秒杀", ""),
    ("男士", "男"), ("男性", "男"), ("女士", "女"), ("女性", "女"),
    ("色", ""), ("馆", ""), ("区", ""), ("品", ""),
]

# Product name clean-up, in this order.
PRODUCT_REPLACEMENTS = [
    ("专卖店", " "), ("专卖", " "), ("网上", " "), ("专区", " "), ("发货", " "),
    ("作者　　", "作者"), ("作　　者", "作者"), ("作　者", "author"),
    ("作    者", "作者"), ("作   者", "作者"), ("作  者", "作者"), ("作 者", "作者"),
    ("品牌名称", " "), ("品牌名", " "), ("品牌", " "), ("更多", " "), ("其他", " "), ("其它", " "),
    ("专柜", " "), ("皇冠", " "), ("正品", " "), ("自由", " "), ("未知", " "), ("\r\n", " "),
    ("品　　牌", " "), ("品　牌", " "), ("品    牌", " "), ("品   牌", " "), ("品  牌", " "), ("品 牌", " "),
    ("导　　演", "导演"), ("导　演", "导演"), ("导    演", "导演"), ("导   演", "导演"),
    ("导  演", "导演"), ("导 演", "导演"),
    ("演　　员", "主演"), ("演　员", "主演"), ("演    员", "主演"), ("演   员", "主演"),
    ("演  员", "主演"), ("演 员", "主演"), ("演员", "主演"),
    ("主　　演", "主演"), ("主　演", "主演"), ("主    演", "主演"), ("主   演", "主演"),
    ("主  演", "主演"), ("主 演", "主演"),
    (":", "："), ("’", "'"),
]

# Country and region names, in this order.
COUNTRY_NAMES = (
    "澳大利亚 委内瑞拉 白俄罗斯 马来西亚 新加坡 新西兰 叙利亚 西班牙 意大利 俄罗斯 加拿大 阿根廷 以色列 奥地利 "
    "韩国 瑞士 中国 大陆 港台 台湾 香港 澳门 美国 法国 日本 英国 德国 印度 泰国 荷兰 巴西 丹麦 瑞典 捷克 俄国 国际"
).split(" ")

# Role and edition words, in this order (one of them starts with a space).
ROLE_WORDS = (
    "本书编写组,本书编辑部,本书编委会,本书编委,本书编辑,编委会,艺术家,演奏者,编委员,委员会,编辑部,杂志社,教材组,"
    "歌手,未知,组编,监制,简介,编辑,编译,翻译,译者,创编,编著,编者,选注,解说词,解说,说词,合著者,合著,合编,原著,著者,"
    "校注,校对,选编,其他,主演,导演,演员,配音,主讲,写字,书者,改编,改写,编选,作者,主编,编写,编审,组织,辑校,丛书,注释,"
    "注译,教学,讲解,绘画,插图,示范,春秋,战国,晋国,宋代,清代,东晋,明代,唐代,元代,国语,韩语,日语,俄语,英语,国粤,粤语,"
    "双语,双音,美语,发音,字幕,中文,等编,等写,等作,等著,等导,等演,等唱,本社, 书,译,等,著,编,dubber,www,com,http"
).split(",")

# Single characters and their plain forms (full-width letters and digits follow by rule).
_PLAIN_FROM = "　●éè，。＜＞｜《》［］？“”：（）－～！"
_PLAIN_TO = " ．ee,.<>|<>[]?'':()-~!"
_WIDE = [chr(i + 0xFEE0) for i in range(0x21, 0x7F) if chr(i).isalnum()]
PLAIN_FROM = _PLAIN_FROM + "".join(_WIDE)
PLAIN_TO = _PLAIN_TO + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)

# Captions that name an attribute rather than a product.
ATTRIBUTE_KEYS = (
    "简介 说明 描述 信息 方法 用法 功效 功能 效果 特性 特点 性能 外观 包装 花语 属性 注意 产地 成分 规格 设计 用途 介绍 "
    "详请 详述 插图 图片 细节 尺寸 大小 参数 声明 售后 服务"
).split(" ")

# Navigation captions, the "other" caption and the code that blanks a caption.
MORE_CAPTIONS = ["更多", "查看上级分类"]
OTHER_CAPTION = "其他"
BACK_MARK = "&#8249;"


# ---------------------------------------------------------------- regex and classes

def extract_regex_key(value, regex: str) -> Column:
    """First case-insensitive match: group 1 if a group of the pattern took part in it, else all of it."""
    pattern = JavaPattern(regex.strip(), ignore_case=True)
    if not regex.strip() or not pattern.valid:
        return F.lit("")
    text = trim_ws(value)
    whole = F.regexp_extract(text, pattern.text, 0)
    if not pattern.groups:
        return F.coalesce(whole, F.lit(""))
    parts = [F.regexp_extract(text, pattern.text, i) for i in range(1, pattern.groups + 1)]
    # A group may have matched the empty text; then, and only then, a reference to it matches behind it.
    took_part = F.rlike(text, F.lit(pattern.followed_by("|".join(f"\\{i}" for i in range(1, pattern.groups + 1)))))
    some = took_part
    for part in parts:
        some = some | (part != "")
    return F.coalesce(F.when(some, parts[0]).otherwise(whole), F.lit(""))


def is_trim_empty(c) -> Column:
    return trim_ws(F.coalesce(col(c), F.lit(""))).isin("", "void(null)", "void(0)")


def is_blank(c) -> Column:
    return F.coalesce(col(c), F.lit("")) == ""


def is_all_letter(c) -> Column:
    return col(c).rlike(r"\A\p{L}+\z")


def is_all_number(c) -> Column:
    return col(c).rlike(rf"\A[{_DIGIT}]+\z")


def is_all_float(c) -> Column:
    return col(c).rlike(r"(?dU)^[+-]?\d+\.?\d*$")


def is_all_letter_or_number(c) -> Column:
    return col(c).rlike(r"\A[\p{L}\p{N}]+\z")


def is_all_letter_or_float(c) -> Column:
    return col(c).rlike(r"(?d)^[a-zA-Z0-9.+\-]+$")


def has_number(c) -> Column:
    return col(c).rlike(rf"[{_DIGIT}]")


def has_chinese(c) -> Column:
    return col(c).rlike(rf"[{_CHINESE}]")


def is_all_chinese(c) -> Column:
    return col(c).rlike(rf"(?d)^[{_CHINESE}]+$")


def is_all_english(c) -> Column:
    return ~has_chinese(c)


def has_letter(c) -> Column:
    return col(c).rlike("[A-Za-z]")


def is_letter_char(c) -> Column:
    return col(c).rlike(r"\A\p{L}\z")


def is_number_char(c) -> Column:
    return col(c).rlike(rf"\A[{_DIGIT}]\z")


def is_same(a, b) -> Column:
    ea, eb = is_trim_empty(a), is_trim_empty(b)
    return F.when(ea & eb, True).when(ea | eb, False).otherwise(col(a) == col(b))


def text_class(c) -> Column:
    """AGG-08: letters, digits, float, Chinese, letters+digits, else other; first hit wins."""
    c = col(c)
    return (
        F.when(is_all_letter(c), "letter")
        .when(is_all_number(c), "number")
        .when(is_all_float(c), "float")
        .when(is_all_chinese(c), "chinese")
        .when(is_all_letter_or_number(c), "letter_number")
        .otherwise("other")
    )


# ---------------------------------------------------------------- formatting and case

def zero_fill(value, length: int) -> Column:
    """Pad an integer with zeros behind its sign; longer numbers are never cut."""
    v = col(value).cast("bigint")
    s = v.cast("string")
    return (
        F.when(F.length(s) >= length, s)
        .when(v < 0, F.concat(F.lit("-"), F.lpad(F.substr(s, F.lit(2)), length - 1, "0")))
        .otherwise(F.lpad(s, length, "0"))
    )


def title_words(c) -> Column:
    """Capital first letter for each a-z run; text with at most 3 such letters goes upper-case."""
    return let(trim_ws(F.lower(F.coalesce(col(c), F.lit("")))), _title)


def _title(s: Column) -> Column:
    cased = F.transform(
        F.regexp_extract_all(s, F.lit("[a-z]+[^a-z]*|[^a-z]+"), F.lit(0)),
        lambda r: F.when(
            F.ascii(r).between(97, 122), F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2)))
        ).otherwise(r),
    )
    four_letters = s.rlike(r"\A(?:[^a-z]*[a-z]){4}")
    return F.when(four_letters, F.array_join(cased, "")).otherwise(F.upper(s))


def to_space_replace(c) -> Column:
    return trim_ws(F.lower(F.regexp_replace(col(c), rf"[^\p{{L}}{_DIGIT}]+", " ")))


def path_key(c) -> Column:
    """One path element reduced to case-folded letters and digits."""
    return F.replace(F.lower(F.regexp_replace(col(c), r"[^\p{L}\p{N}]+", "")), F.lit("ß"), F.lit("ss"))


def path_keys(path) -> Column:
    return F.transform(col(path), path_key)


# ---------------------------------------------------------------- cleaning

def decode_codes(c) -> Column:
    c = col(c)
    decoded = F.when(F.contains(c, F.lit(";")), replace_all(c, ENTITY_CODES)).otherwise(c)
    return replace_all(decoded, URL_CODES)


def _code_point(number: Column) -> Column:
    n = number.try_cast("bigint")
    usable = (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(usable, char)


def _decode_refs(c: Column, head: str) -> Column:
    refs = F.array_distinct(F.regexp_extract_all(c, F.lit(f"{head}([0-9]{{2,}});"), F.lit(1)))

    def step(text: Column, number: Column) -> Column:
        ref = F.concat(F.lit(head), number, F.lit(";"))
        return F.replace(text, ref, F.coalesce(_code_point(number), ref))

    return F.aggregate(refs, c, step)


def decode_numeric_refs(c) -> Column:
    """``&#NN;`` references to characters; the form without ``#`` only if no ``&#`` occurs."""
    return let(col(c), _decode_all_refs)


def _decode_all_refs(c: Column) -> Column:
    return (
        F.when(F.coalesce(trim_ws(c), F.lit("")) == "", "")
        .when(~F.contains(c, F.lit(";")), c)
        .when(F.contains(c, F.lit("&#")), _decode_refs(c, "&#"))
        .when(F.contains(c, F.lit("&")), _decode_refs(c, "&"))
        .otherwise(c)
    )


def clean_category(c) -> Column:
    return trim_ws(replace_all(col(c), CATEGORY_REPLACEMENTS))


def numbers_to_chinese(c) -> Column:
    return F.translate(F.lower(col(c)), NUMERALS_FROM, NUMERALS_TO)


def compare_form(c) -> Column:
    return F.lower(numbers_to_chinese(replace_all(col(c), COMPARE_REPLACEMENTS)))


def clean_product_name(c) -> Column:
    def finish(s: Column) -> Column:
        # Most names hold no '&', which is far cheaper to see than the patterns are to run.
        plain = F.regexp_replace(F.regexp_replace(s, "(?i)&amp;", "&"), "(?i)&nbsp;", " ")
        return let(trim_ws(F.when(F.contains(s, F.lit("&")), plain).otherwise(s)), _drop_lead_colon)

    return let(replace_all(col(c), PRODUCT_REPLACEMENTS), finish)


def _drop_lead_colon(s: Column) -> Column:
    lead = F.left(s, F.lit(1)).isin(":", "：") & (F.length(s) > 1)
    return F.when(lead, F.substr(s, F.lit(2))).otherwise(s)


def split_name_type(c) -> Column:
    """``struct(name, type)``: brand in front, model behind."""
    return let(trim_ws(F.coalesce(col(c), F.lit(""))), _split_name_type)


def _split_name_type(t: Column) -> Column:
    size, space = F.length(t), F.instr(t, " ")
    first_ascii = F.ascii(t) < 128
    wide = lambda at: F.ascii(F.substr(t, at, F.lit(1))) > 127
    by_space = F.struct(
        F.substr(t, F.lit(1), space - 1).alias("name"), F.substr(t, space + 1).alias("type")
    )
    run = F.length(F.regexp_extract(t, r"\A(?:[\x00-\x7F]+|[^\x00-\x7F]+)", 0))
    tail = F.substr(t, run + 1)
    by_class = F.struct(
        F.left(t, run).alias("name"),
        F.when(F.startswith(tail, F.lit(" ")), F.substr(tail, F.lit(2))).otherwise(tail).alias("type"),
    )
    none = F.struct(F.lit("").alias("name"), F.lit("").alias("type"))
    clear_space = (space >= 2) & (space + 1 <= size) & (
        first_ascii | (wide(space - 1) & wide(space + 1))
    )
    return (
        F.when(is_trim_empty(t), none)
        .when(clear_space, by_space)
        .when(run < size, by_class)
        .when(space > 0, by_space)
        .otherwise(none)
    )


def space_scripts(c) -> Column:
    """One space wherever ASCII and other text meet."""
    edge = r"(?<=[\x00-\x7F])(?=[^\x00-\x7F])|(?<=[^\x00-\x7F])(?=[\x00-\x7F])"
    spaced = F.regexp_replace(F.regexp_replace(col(c), edge, " "), " +", " ")
    return F.when(is_trim_empty(c), "").otherwise(trim_ws(spaced))


def ignore_case_replace(c, old: str, new: str) -> Column:
    """``old`` is a regular expression, ``new`` may refer to groups as ``\\1``."""
    import re

    pattern = JavaPattern(old, ignore_case=True)
    if not pattern.valid:
        raise ValueError(f"bad pattern: {old!r}")
    target = re.sub(r"\\(\d)", r"$\1", new.replace("$", r"\$"))
    return F.regexp_replace(col(c), pattern.text, target)


def drop_countries(c) -> Column:
    return trim_ws(replace_all(col(c), [(name, " ") for name in COUNTRY_NAMES]))


def drop_role_words(c) -> Column:
    s = drop_countries(replace_all(col(c), [(word, " ") for word in ROLE_WORDS]))
    tokens = F.filter(F.split(s, " "), lambda w: F.length(w) > 1)
    return F.array_join(F.array_distinct(tokens), " ")


def is_more_caption(c) -> Column:
    t = col(c)
    hit = F.contains(F.lower(t), F.lit("more"))
    for word in MORE_CAPTIONS:
        hit = hit | F.contains(t, F.lit(word))
    return hit


def clean_caption(c, *, default: str = OTHER_CAPTION, prefix: str = "") -> Column:
    """Category caption, or NULL when the caption is navigation rather than a category."""
    def shorten(named: Column) -> Column:
        return trim_ws(cut_before(cut_before(_or_else(named, default), "（"), "("))

    def finish(short: Column) -> Column:
        caption = _or_else(short, default)
        return F.concat(F.lit(prefix.strip() + "||"), caption) if prefix.strip() else caption

    def clean(coded: Column) -> Column:
        opened = F.replace(coded, F.lit(BACK_MARK), F.lit(" "))
        named = let(clean_category(decode_numeric_refs(opened)), shorten)
        blanked = F.contains(coded, F.lit(BACK_MARK)) & (trim_ws(opened) == "")
        return F.when(~blanked, let(named, finish))

    return let(
        trim_ws(F.coalesce(col(c), F.lit(""))),
        lambda t: F.when(~is_more_caption(t), let(decode_codes(t), clean)),
    )


def _or_else(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def to_plain_chars(c) -> Column:
    """Full-width and typographic characters to their plain forms."""
    return F.translate(col(c), PLAIN_FROM, PLAIN_TO)


def drop_words(tokens, words: Iterable[str]) -> Column:
    """Remove listed words from a token array, keeping order and repeats of the rest."""
    listed = F.array(*[F.lit(w) for w in words])
    return F.filter(col(tokens), lambda w: ~F.array_contains(listed, w))
