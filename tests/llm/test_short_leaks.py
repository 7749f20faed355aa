"""Documents shorter than a benchmark item that still hold nearly all of it."""

from __future__ import annotations

from spherion.llm import decontaminate
from tests.llm.test_documents import table


def test_an_item_with_words_cut_off_leaks(spark):
    words = [f"w{k}" for k in range(50)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(1, words[:47]), (2, words[3:]), (3, words[:30]), (4, words), (5, words[2:49]), (6, ["other"] * 47)]
    docs = table(spark, [(i, " ".join(w)) for i, w in rows])
    got = {x["doc_id"]: (x["similarity"], x["word_start"], x["n_words"]) for x in decontaminate.find_leaks(spark, docs, bench).collect()}
    assert got == {i: (43 / 46, 0, 47) for i in (1, 2, 5)} | {4: (1.0, 0, 50)}
    assert {x["doc_id"] for x in decontaminate.drop_contaminated(spark, docs, bench).collect()} == {3, 6}
