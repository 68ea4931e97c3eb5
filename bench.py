"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
BENCH_QUERIES may name some queries only. Prepared tables (word vectors, term weights, thread
vectors) are timed on their own as ``build_index``, as the searches read them like an index.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from suite import views as V  # noqa: E402
from suite.all import QUERIES  # noqa: E402
from threadloom.session import build_session  # noqa: E402

HEADLINE = (
    "t01_search_text t20_char_ngrams a08_term_idf m01_term_weights v01_average_vectors v05_thread_vectors "
    "v07_nearest_angular w03_neighbours_per_tag w05_most_similar j05_parent_reply j07_duplicate_pairs "
    "j10_answers_to_kept a03_combined_answers a05_best_answer u04_upsert_highest m03_stratified_split "
    "v12_char_ngrams p01_build_posts p04_duplicate_corpus p07_training_pairs p08_encoded_corpus p06_evaluation "
    "p09_topic_answers p05_answers"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session("bench", cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name, work):
        start = time.time()
        work()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    timed("build_index", lambda: [view(spark, sf) for view in (V.word_vectors, V.idf, V.thread_vectors, V.thread_index, V.doc_weights)])
    for name in names:
        timed(name, lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    questions = V.questions(spark, sf).count()
    report = {
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
        "cpus": cpus, "questions": questions,
    }
    if "p05_answers" in times and questions:
        report["sec_per_question"] = round(times["p05_answers"] / questions, 4)
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
