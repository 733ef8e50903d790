import datetime as dt
import random

from pyspark.sql import functions as F

from vectorvote.plans import requests as rq

DAY = 86_400_000_000


def brute(events):
    """event_id -> (last_micros, tx_24h, avg_before, known), event by event."""
    out = {}
    for e in events:
        now = (-1 if e[3] is None else e[3], e[0])
        earlier = sorted((x for x in events if x[1] == e[1] and (-1 if x[3] is None else x[3], x[0]) < now), key=lambda x: (-1 if x[3] is None else x[3], x[0]))
        cents = [round(x[4] * 100) for x in earlier if x[4] is not None]
        out[e[0]] = (
            earlier[-1][3] if earlier else None,
            0 if e[3] is None else sum(x[3] is not None and e[3] - DAY <= x[3] < e[3] for x in earlier),
            round(sum(cents) / len(cents) / 100, 9) if cents else 0.0,
            any(x[2] == e[2] for x in earlier),
        )
    return out


def test_derived_matches_brute_force_on_a_hot_user(spark):
    r = random.Random(3)
    start = 19_700 * DAY
    events = []
    for k in range(300):
        user = 1 if k % 3 else r.choice([2, 3, None])
        micros = start + r.choice([r.randrange(6 * DAY), r.randrange(6) * DAY, r.randrange(3) * DAY + 5])  # ties and midnights too
        events.append((k, user, r.choice(["a", "b", "c", None]), micros if k % 37 else None, r.choice([None, round(r.uniform(-5, 90), 2)])))
    epoch = dt.datetime(1970, 1, 1)
    rows = [(k, u, t, None if m is None else epoch + dt.timedelta(microseconds=m), v) for k, u, t, m, v in events]
    docs = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz, value double")
    got = rq.derived(docs)
    assert got.columns == [*docs.columns, "micros", "last_micros", "tx_24h", "avg_before", "known"]
    found = {x[0]: tuple(x[1:]) for x in got.select("event_id", "last_micros", "tx_24h", F.round("avg_before", 9), "known").collect()}
    assert found == brute(events)


def test_derived_of_no_events(spark):
    docs = spark.createDataFrame([], "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz, value double")
    assert rq.derived(docs).count() == 0
