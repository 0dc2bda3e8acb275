"""Registered queries read whole rows; small tables with results worked out by hand."""

from sightline import catalogue


def test_plan_reads_the_whole_text(spark, tmp_path):
    filler = "plain filler words " * 40
    texts = [(11, filler + "yesterday evening she said it"), (23, filler + "on day 6"), (35, filler), (47, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.qid: (r.days, r.relative_day, r.time_of_day, r.modalities) for r in catalogue.plan_sentences(spark, str(tmp_path)).collect()}
    assert got[11] == ("DAY4", "yesterday", "evening", "audio,text,video")
    assert got[23] == ("DAY6", "explicit", "", "text,video,audio")
    assert got[35] == ("DAY1", "same_day", "", "audio,text,video") and got[47][1] == "same_day"
