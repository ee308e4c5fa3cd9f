from graphloom.sources.files import html_to_markdown, markdown_to_html
from pyspark.sql import functions as F


def test_long_headings_stay_whole(spark):
    texts = ["# " + "abcde " * 30_000 + "end", "# short\n\ntext", "# "]
    got = [r.m for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(html_to_markdown(markdown_to_html(F.col("t"))).alias("m")).collect()]
    assert got[0] == texts[0] and got[1] == texts[1]
