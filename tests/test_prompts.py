"""Prompt lines say each fragment's rewriting once."""

import pytest
from pyspark.sql import functions as F

from lumenreel.functions import text as T


@pytest.mark.parametrize("given", ["", "  see above;  the same man ,. ", "a man"])
def test_fragments_are_rewritten_once(spark, given):
    c = F.col("c")
    assert str(T.sentence(c)).count("regexp_replace") == str(T.prompt_value(c)).count("regexp_replace")
    none = F.lit("")
    whole = T.prompt_text(F.lit("image"), c, none, none, none, none, none, none, none, ())
    assert str(whole).count("'c") <= 1 and str(whole).count("(c,") <= 1
    got = spark.createDataFrame([(given,)], "c string").select(T.sentence(c).alias("s"), whole.alias("w")).first()
    assert got.s == got.w == {"": "", "  see above;  the same man ,. ": "Within this frame, the shared man.", "a man": "A man."}[given]
