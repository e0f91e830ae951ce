import random

from quire.llm import ngrams


def test_a_large_group_of_copies_leaves_the_recall_at_the_threshold(spark):
    """2,000 pairs at a Jaccard of exactly 0.8 beside 244,650 pairs above 0.9: depth 7 would lose 46 of the 2,000, depth 5 three or four."""
    rng = random.Random(8)
    word = lambda: f"w{rng.getrandbits(48):x}"
    docs = []
    for _ in range(2000):
        base = [word() for _ in range(94)]  # 90 shingles; the last ten words stand in ten of them
        docs += [" ".join(base), " ".join(base[:84] + [word() for _ in range(10)])]
    big = [word() for _ in range(200)]
    for i in range(700):
        own = list(big)
        own[rng.randrange(200)] = f"x{i}"
        docs.append(" ".join(own))
    got = ngrams.ngram_join(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3))
    linked = got.filter("doc_id < 4000 AND n_links > 0").count()
    assert linked >= 2 * 0.994 * 2000
    assert got.filter("doc_id < 4000 AND doc_id <> component_id AND doc_id <> component_id + 1").count() == 0


def test_depth_follows_from_threshold_and_recall():
    assert ngrams.depth_for(ngrams.JACCARD, ngrams.RECALL) == 5
    assert ngrams.depth_for(0.95, ngrams.RECALL) == ngrams.DEEP
