import re
import string

from newsloom import catalog


def test_whole_statements(spark, tmp_path):
    head = "One beginning that two statements share, which is longer than eighty characters are, "
    texts = [head + "A.", head + "B)!", "  x \n\t y\u00a0z?\"", "...", "", "Straße ÉÉ #[]{}~", "a . ", "a\\^`", "a\x1fb", head * 100 + "#"]
    spark.createDataFrame([(1, i, t) for i, t in enumerate([*texts, None])], "conv_id int, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.statement for r in catalog.QUERIES["statement_normalize"](spark, str(tmp_path)).collect()}
    assert got == {i: re.sub(r"\s+", " ", t.strip()).lower().rstrip(string.punctuation) for i, t in enumerate(texts)} | {len(texts): None}
