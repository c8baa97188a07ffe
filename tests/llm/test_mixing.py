from mirefold.llm.mixing import mixed


def frame(spark):
    rows = [(i, "x" * (20 + i % 37), "big") for i in range(3000)] + [(10_000 + i, "y" * (30 + i % 11), "small") for i in range(90)] + [(20_000, None, "small"), (20_001, "", "small"), (20_002, "z", None), (20_003, "z", "other")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as rank", "2 as copies_before")


def test_shares_and_caps(spark):
    out = mixed(frame(spark), "doc_id", "text", "source", [("big", 0.8, 2), ("small", 0.2, 3)]).toPandas()
    assert set(out.source) == {"big", "small"} and out.copies.max() <= 3 and out[out.source == "big"].copies.max() <= 2
    tokens = (out.n_tokens * out.copies).groupby(out.source).sum()
    share = tokens / tokens.sum()
    assert abs(share["big"] - 0.8) < 0.005
    for s in share.index:
        assert abs(out[out.source == s].actual_share.iloc[0] - share[s]) < 1e-9
    assert not out.doc_id.duplicated().any()


def test_same_seed_same_sample(spark):
    take = lambda seed: set(mixed(frame(spark), "doc_id", "text", "source", [("big", 0.8, 1), ("small", 0.2, 2)], seed=seed).toPandas().doc_id)
    assert take(1) == take(1) != take(2)


def test_odd_targets(spark):
    df = frame(spark)
    assert mixed(df, "doc_id", "text", "source", [("absent", 1.0, 2)]).count() == 0
    assert mixed(df.limit(0), "doc_id", "text", "source", [("big", 1.0, 2)]).count() == 0
    out = mixed(df, "doc_id", "text", "source", [("big", 0.5, 1), ("absent", 0.5, 1)]).toPandas()
    assert len(out) == 3000 and out.copies.eq(1).all()
    few = mixed(df, "doc_id", "text", "source", [("big", 1.0, 1)], total=1000).toPandas()
    assert abs((few.n_tokens * few.copies).sum() - 1000) <= 60


def test_inclusion_is_even(spark):
    df = frame(spark).where("source = 'big'")
    hits = 0
    for seed in range(6):
        out = mixed(df, "doc_id", "text", "source", [("big", 1.0, 1)], seed=seed, total=30_000).toPandas()
        hits += (out.doc_id < 1500).sum() / len(out)
    assert 0.4 < hits / 6 < 0.6


def test_chances_grow_with_size(spark):
    df = spark.createDataFrame([(i, "x" * (10 if i % 2 else 200), "a") for i in range(4000)], "doc_id long, text string, source string")
    long_share = lambda power: (mixed(df, "doc_id", "text", "source", [("a", 1.0, 1)], total=60_000, power=power).toPandas().n_tokens == 200).mean()
    assert 0.4 < long_share(0.0) < 0.6 and long_share(1.0) > 0.9


def test_odds_decide_at_the_cut(spark):
    df = spark.createDataFrame([(i, "x" * (10 if i % 2 else 40), "a") for i in range(4000)], "doc_id long, text string, source string")
    out = mixed(df, "doc_id", "text", "source", [("a", 1.0, 2)], total=120_000).toPandas()
    assert abs((out.n_tokens * out.copies).sum() - 120_000) <= 40
    by_size = out.groupby("n_tokens").copies.sum() / 2000
    assert 3.5 < by_size[40] / by_size[10] < 4.5  # expected copies are in proportion to size
    assert out[out.n_tokens == 40].copies.min() == 1  # the whole part is certain


def test_a_repeated_id_is_one(spark):
    df = spark.createDataFrame([(1, "x" * 20, "a")] * 5000 + [(i, "x" * 20, "a") for i in range(2, 3000)], "doc_id long, text string, source string")
    out = mixed(df, "doc_id", "text", "source", [("a", 1.0, 1)], total=40_000).toPandas()
    assert (out.doc_id == 1).sum() in (0, 5000)
