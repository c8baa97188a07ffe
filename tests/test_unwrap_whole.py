from mirefold.plans import reference
from mirefold.session import table


def test_every_rewritten_field_is_unwrapped(spark, small):
    out = reference.QUERIES["url_unwrap_chains"](spark, small).select("ioc_id").distinct().count()
    assert out == table(spark, small, "ioc").where("trim(rewritten_from) <> ''").count()
