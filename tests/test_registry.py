from __future__ import annotations

from pyspark.sql import functions as F

from catloom.functions import convert, registry, text, urls
from catloom.plans.views import texts

SAME = {
    "is_trim_empty": text.is_trim_empty, "is_blank": text.is_blank, "is_all_letter": text.is_all_letter,
    "is_all_letter_or_number": text.is_all_letter_or_number, "is_all_float": text.is_all_float, "has_letter": text.has_letter,
    "has_chinese": text.has_chinese, "is_all_chinese": text.is_all_chinese, "is_all_english": text.is_all_english, "path_key": text.path_key,
    "decode_codes": text.decode_codes, "clean_category": text.clean_category, "numbers_to_chinese": text.numbers_to_chinese,
    "compare_form": text.compare_form, "drop_countries": text.drop_countries, "to_plain_chars": text.to_plain_chars,
    "is_page_href": urls.is_page_href, "clean_url": urls.clean_url, "to_integer": convert.to_integer, "to_number": convert.to_number,
}


def test_sql_functions_agree(spark):
    names = registry.register(spark)
    assert "cat_zero_fill" in names
    rows = texts(spark, "/root/testdata/sf0.001")
    differs = [F.count_if(~F.expr(f"cat_{n}(text)").eqNullSafe(f("text"))).alias(n) for n, f in SAME.items()]
    assert rows.agg(*differs).first().asDict() == dict.fromkeys(SAME, 0)
    assert tuple(spark.sql("select cat_zero_fill(-7, 4), cat_zero_fill(12345, 3), cat_store_bucket('00ab', 'C', 2)").first()) == ("-007", "12345", "C-AB")
