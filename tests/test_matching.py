"""Worker matching against a loop."""

import random

from buildlens.operators import workers as W


def test_worker_match_against_a_loop(spark):
    rnd = random.Random(5)
    names = ["linux", "gpu", "big", "arm", "ssd"]
    fleet = [
        (k, rnd.choice(["a", "b", None]), ["linux", *rnd.sample(names[1:], rnd.randrange(4))], rnd.choice(["idle", "idle", "busy"]), rnd.randrange(30))
        for k in range(60)
    ]
    asked = [(k, rnd.choice(["a", "b", "c", None]), rnd.sample([*names, "absent"], rnd.randrange(4))) for k in range(200)]
    asked += [(200, "a", ["gpu", "gpu"]), (201, None, None)]
    want = {}
    for k, kind, labels in asked:
        fit = [(w[4], w[0]) for w in fleet if labels is not None and w[3] == "idle" and kind in (None, w[1]) and set(labels) <= set(w[2])]
        want[k] = min(fit)[1] if fit else None
    workers = spark.createDataFrame(fleet, "worker_id int, worker_type string, offered array<string>, state string, heartbeat int")
    requests = spark.createDataFrame(asked, "request_id int, worker_type string, required array<string>")
    assert {r.request_id: r.worker_id for r in W.worker_match(requests, workers).collect()} == want
    assert W.worker_match(requests, workers.limit(0)).filter("worker_id IS NOT NULL").count() == 0
