"""Copies of images beyond what is broadcast at once."""

from lethe.llm import media

from test_pages_media_pipeline import _pictures


def test_beyond_the_broadcast_limits_no_picture_or_feature_is_shuffled(spark, monkeypatch):
    rows = [(k, media.encode(p)) for k, p in _pictures().items()]
    rows += [(3, None), (None, rows[0][1]), (400, rows[1][1]), (2, rows[5][1])]  # null, without an id, a copy, an id of two pictures
    images = spark.createDataFrame(rows, "media_id long, image binary").repartition(3)
    key = lambda r: tuple((x is not None, x) for x in r)
    result = lambda: sorted((tuple(r) for r in media.copies(images, lambda c: c % 10 == 0).collect()), key=key)
    want, plans = result(), []
    assert sum(bool(r[3]) for r in want) >= 6

    def seen(df, name, *more, kept=media.saved):
        if name in ("near", "features"):
            plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name, *more)

    monkeypatch.setattr(media, "saved", seen)
    monkeypatch.setattr(media, "BROADCAST_ROWS", 12)
    monkeypatch.setattr(media, "BROADCAST_FEATURES", 2_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert result() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [n for n, _ in plans].count("near") > 1
    for name, plan in plans:
        assert plan.count("Exchange hashpartitioning") == (1 if name == "near" else 0), plan
