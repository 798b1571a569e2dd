"""Signals of prompts on odd letters and spaces against their SQL."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tessellar.functions import words
from tessellar.plans import texts

ODD = ("beenbe testä erlich", "ätest", "nur tests.", "teﬅ teſt", "ſtop", "don'tß", "ätest only\u00e9", "K.K end", "\u0131/\u0131", "ä/ö", "지마\u2028", "지\x0b마", "a\x0bb c", "\u3000a b\u00a0", "\u00a0", "", "pass!")


def test_signals_are_those_of_sql(spark):
    df = pd.DataFrame([(i, 0, "user", t) for i, t in enumerate(ODD)], columns=["conv_id", "turn", "role", "text"])
    con = duckdb.connect()
    con.register("conversations", df)
    want = con.execute(f"select conv_id, verification, context, stop, words from ({texts.SQL_PROMPTS}) order by conv_id").fetchall()
    shown = words.prompt_signals(F.col("text"))
    got = spark.createDataFrame(df).select("conv_id", *[c.alias(n) for n, c in shown.items()]).orderBy("conv_id").collect()
    assert [(r.conv_id, r.verification, r.context, r.stop, r.words) for r in got] == want
