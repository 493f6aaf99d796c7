from yakinma.plans.complaints import TEXT_COLUMNS, best_texts


def test_keeps_3000_characters_and_highlights_the_whole_text(spark, tmp_path):
    bodies = [None, "kısa iade", "x" * 400 + " Koltuk & iade", "y" * 3000, "z" * 3500 + " iade"]
    schema = "id bigint, " + ", ".join(f"{c} string" for c in TEXT_COLUMNS[1:])
    df = spark.createDataFrame([(i, *[b if c == "complaint_text" else None for c in TEXT_COLUMNS[1:]]) for i, b in enumerate(bodies)], schema)
    df.write.parquet(str(tmp_path / "complaints.parquet"))
    got = {r.id: (r.text, r.html) for r in best_texts(spark, str(tmp_path)).collect()}
    assert got == {
        0: ("—", "—"),
        1: ("kısa iade", "kısa <b>iade</b>"),
        2: (bodies[2], "x" * 400 + " <b>Koltuk</b> &amp; <b>iade</b>"),
        3: (bodies[3], bodies[3]),
        4: ("z" * 3000 + "…", "z" * 3500 + " <b>iade</b>"),
    }
