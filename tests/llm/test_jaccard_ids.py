"""Joins of many texts under one id, or under none: each text is found again once."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scenelake.llm import jaccard

from .test_llm import make, prose


@pytest.mark.parametrize("one", [None, 7])
def test_many_texts_without_ids_of_their_own(spark, one):
    rng = random.Random(1)
    words = [prose(rng, 60).split() for _ in range(1000)]
    near = [" ".join(w[:-1]) for w in words]  # 57 of 58 shingles
    rows = [(one, " ".join(w)) for w in words] + [(one, t) for t in near] + [(3, near[0]), (4, "alone in the world of texts")]
    began = time.monotonic()
    got = jaccard.join(make(spark, rows), width=3, num=90, den=100).groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert time.monotonic() - began < 120
    assert sum(r.n for r in got) == len(rows)
    told = {(r.doc_id, r.component_id): r.n for r in got}
    assert told[3, 3] == 1 and told[4, 4] == 1  # the smallest id of its class, and a text of its own
    assert told[one, 3] == 2 and told[one, one] == 1998
