"""op5: ratios and scores against plain loops."""

import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from jobsift.llm import classifier
from llm_helpers import SMOKE, docs  # noqa: F401


def test_ratios_and_scores_of_plain_loops(spark, docs):
    labels = spark.read.parquet(f"{SMOKE}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    learn = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = classifier.train(docs, learn)
    texts = {r.doc_id: r.text for r in docs.collect()}
    features = classifier.Features()
    counts = [Counter(), Counter()]
    for r in labels.collect():
        if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5:
            counts[r.label].update(set(features(texts[r.doc_id]).tolist()))
    total = [sum(c.values()) + classifier.DIMS for c in counts]
    seen = set(counts[0]) | set(counts[1])
    for b in [*sorted(seen)[:2000], *(x for x in range(50) if x not in seen)]:
        want = math.log((counts[1][b] + 1) / total[1]) - math.log((counts[0][b] + 1) / total[0])
        assert abs(model.ratio[b] - want) < 1e-9
    for r in classifier.score(docs, model).select("doc_id", "score").collect():
        idx = set(features(texts[r.doc_id]).tolist())
        norm = math.sqrt(sum(model.ratio[b] ** 2 for b in idx)) or 1.0
        margin = sum(model.weight[b] * model.ratio[b] / norm for b in idx) + model.weight[-1]
        assert abs(r.score - 1 / (1 + math.exp(-(model.slope * margin + model.offset)))) < 1e-9
