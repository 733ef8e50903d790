import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorvote.config import ConfigError, NormalizationConfig, SearchConfig, TrainConfig
from vectorvote.functions import features, random, scalar
from vectorvote.sources import codec, readers

#: Values of ours.
CONFIG = NormalizationConfig(2_000, 24, 8, 720, 500, 40, 400)
RISK = {"4111": 0.35, "7995": 0.9}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize("value,top,want", [(5, 10, 0.5), (-1, 10, 0), (20, 10, 1), (3, 0, 0), (3, -1, 0)])
def test_clamp_ratio(spark, value, top, want):
    assert one(spark, scalar.clamp_ratio(lit(value), top)) == want


@pytest.mark.parametrize("a,m,want", [(0, 0, 0), (-1, 0, 0), (5, 0, 1), (5, -2, 1), (50, 10, 0.5), (500, 10, 1), (0, 5, 0)])
def test_amount_vs_average(spark, a, m, want):
    assert one(spark, scalar.amount_vs_average(lit(a), lit(m), 10)) == want


def test_nan_stays_in_clamp_and_is_zero_quantised(spark):
    assert np.isnan(one(spark, scalar.clamp_unit(lit(float("nan")).cast("float"))))
    assert one(spark, scalar.quantize(lit(float("nan")))) == 0


def test_quantize(spark):
    for x, want in ((0.00005, 1), (-0.00005, -1), (0.5, 5000), (-1, -10000), (9, 32767), (-9, -32768)):
        assert one(spark, scalar.quantize(lit(x))) == want


@pytest.mark.parametrize(
    "text,ok",
    [("2026-03-11T18:45:53Z", True), ("2026-03-11t18:45:53z", True), ("2026-03-11T18:45:53.25+02:00", True), ("2026-03-11", False), ("2026-03-11T18:45:53", False), ("not-a-timestamp", False), ("2026-13-11T18:45:53Z", False), (None, False)],
)
def test_timestamps(spark, text, ok):
    assert (one(spark, scalar.parse_utc(F.lit(text).cast("string"))) is not None) == ok


def request(**changes):
    base = {
        "id": "r7", "transaction": {"amount": 150.0, "installments": 6, "requested_at": "2025-11-02T09:30:15Z"}, "customer": {"avg_amount": 50.0, "tx_count_24h": 10, "known_merchants": ["shop", "kiosk"]},
        "merchant": {"id": "kiosk", "mcc": "4111", "avg_amount": 100.0}, "terminal": {"is_online": True, "card_present": False, "km_from_home": 125.0}, "last_transaction": None,
    }
    return base | changes


def vector(spark, body):
    rows = readers.decode_requests(spark.createDataFrame([(json.dumps(body),)], "value string"))
    return features.vectorize(rows, CONFIG, RISK).first()["vector"]


def rules(body, config=CONFIG, risk=RISK):
    """The 14 features in plain Python, from the rules: each ratio clamped to 0..1, both "since last" features -1 without a last transaction."""
    from datetime import datetime, timezone

    tx, customer, merchant, terminal, last = (body[k] for k in ("transaction", "customer", "merchant", "terminal", "last_transaction"))
    at = lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")).astimezone(timezone.utc)
    unit = lambda x: min(max(x, 0.0), 1.0)
    now = at(tx["requested_at"])
    ratio = unit(tx["amount"] / customer["avg_amount"] / config.amount_vs_avg_ratio) if customer["avg_amount"] > 0 else float(tx["amount"] > 0)
    minutes = km = -1.0
    if last:
        minutes = unit(max(0, int((now - at(last["timestamp"])).total_seconds())) / 60 / config.max_minutes)
        km = unit(last["km_from_current"] / config.max_km)
    return [
        unit(tx["amount"] / config.max_amount), unit(tx["installments"] / config.max_installments), ratio, now.hour / 23, now.weekday() / 6, minutes, km, unit(terminal["km_from_home"] / config.max_km),
        unit(customer["tx_count_24h"] / config.max_tx_count_24h), float(terminal["is_online"]), float(terminal["card_present"]), float(merchant["id"] not in customer["known_merchants"]),
        risk.get(merchant["mcc"], 0.5), unit(merchant["avg_amount"] / config.max_merchant_avg_amount),
    ]


def test_vector_by_hand(spark):
    # 150 of 2000; 6 of 24; 150 / 50 / 8; 9 of 23; Sunday, 6 of 6; 125 of 500; 10 of 40; 100 of 400
    want = [0.075, 0.25, 0.375, 9 / 23, 1, -1, -1, 0.25, 0.25, 1, 0, 0, 0.35, 0.25]
    assert vector(spark, request()) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    "changes",
    [
        {},
        {"transaction": {"amount": 9000.0, "installments": 40, "requested_at": "2025-07-14T23:59:59.9+05:30"}, "merchant": {"id": "stranger", "mcc": "7995", "avg_amount": 1e6}},
        {"customer": {"avg_amount": 0.0, "tx_count_24h": 0, "known_merchants": []}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 0.0}},
        {"customer": {"avg_amount": -3.0, "tx_count_24h": 99, "known_merchants": ["kiosk", "kiosk"]}, "transaction": {"amount": 0.0, "installments": 0, "requested_at": "2024-02-29T00:00:00Z"}},
        {"last_transaction": {"timestamp": "2025-11-02T08:18:15Z", "km_from_current": 60.0}},
        {"last_transaction": {"timestamp": "2025-11-02T10:00:00Z", "km_from_current": 0.0}},  # later than the request
        {"last_transaction": {"timestamp": "2025-11-02T09:29:15.4Z", "km_from_current": 9e9}},  # 59 whole seconds
        {"merchant": {"id": "Kiosk", "mcc": "", "avg_amount": 0.0}},
    ],
)
def test_vector_by_the_rules(spark, changes):
    assert vector(spark, request(**changes)) == pytest.approx(rules(request(**changes)), abs=1e-6)


def errors(spark, *bodies):
    rows = readers.decode_requests(spark.createDataFrame([(json.dumps(b) if isinstance(b, dict) else b,) for b in bodies], "value string"))
    return [r["e"] for r in rows.select(readers.request_error().alias("e")).collect()]


def test_request_errors(spark):
    bad = request(transaction={"amount": 1.0, "installments": 1, "requested_at": "not-a-timestamp"})
    got = errors(spark, request(), bad, request(customer={"avg_amount": 1.0, "tx_count_24h": -1, "known_merchants": []}), request(customer={"avg_amount": 1.0, "tx_count_24h": 1, "known_merchants": [None]}), request(last_transaction={"timestamp": "x", "km_from_current": 1.0}), "{}", "no json", request(extra=1))
    assert got[0] is None and got[7] is None
    assert got[1] == "invalid timestamp: not-a-timestamp" and got[2] == "count out of range" and got[4] == "invalid timestamp: x"
    assert got[3] == got[5] == got[6] == "missing or mistyped field"


def test_references(spark, tmp_path):
    import gzip

    rows = [{"vector": [0.1] * 14, "label": "fraud"}, {"vector": [0.2] * 14, "label": "legit", "more": 1}]
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(rows, f)
    assert [r.label for r in readers.read_references(spark, str(tmp_path / "r.json.gz")).orderBy("ref_id").collect()] == ["fraud", "legit"]  # a file's order
    (tmp_path / "same.json").write_text(json.dumps([rows[0]] * 3))
    assert readers.read_references(spark, str(tmp_path / "same.json")).select("ref_id").distinct().count() == 3
    for wrong in ({"vector": [0.1] * 13, "label": "fraud"}, {"vector": [0.1] * 14, "label": "Fraud"}, {"label": "fraud"}):
        (tmp_path / "w.json").write_text(json.dumps([wrong]))
        with pytest.raises(Exception, match="must"):
            readers.read_references(spark, str(tmp_path / "w.json")).collect()


def test_configuration(tmp_path):
    full = {f: 1.0 for f in NormalizationConfig.__dataclass_fields__}
    (tmp_path / "n.json").write_text(json.dumps(full | {"other": 2}))
    assert NormalizationConfig.load(str(tmp_path / "n.json")).max_km == 1
    (tmp_path / "n.json").write_text(json.dumps({"max_km": 1}))
    for path in ("n.json", "none.json"):
        with pytest.raises(ConfigError):
            NormalizationConfig.load(str(tmp_path / path))
    assert SearchConfig.from_env({"NPROBE": " 4 ", "FAST_NPROBE": ""}).nprobe == 4
    for raw in ("0", "-1", "x"):
        with pytest.raises(ConfigError):
            SearchConfig.from_env({"NPROBE": raw})
    c = SearchConfig()
    assert (c.full(64), c.full(10), c.fast(64), c.fast(3), c.undecided()) == (32, 10, 8, 3, (2, 3))
    assert TrainConfig.offline().clusters == 4096


def test_generator():
    def sequential(seed, n):
        out, mask = [], (1 << 64) - 1
        for _ in range(n):
            seed = (seed + random.GAMMA) & mask
            z = seed
            z = ((z ^ (z >> 30)) * random.FIRST) & mask
            z = ((z ^ (z >> 27)) * random.SECOND) & mask
            out.append(z ^ (z >> 31))
        return out

    assert random.splitmix64(99, np.arange(1, 500)).tolist() == sequential(99, 499)
    u = random.unit_floats(5, np.arange(1, 1000))
    assert u.min() >= 0 and u.max() < 1
    assert random.bounded(5, np.array([1, 2]), np.array([1, 0])).tolist() == [0, 0]


def test_codec(tmp_path):
    r = np.random.default_rng(0)
    cluster = np.sort(r.integers(0, 4, 37))
    cluster[cluster == 2] = 3  # an empty list
    cluster.sort()
    values, label = r.integers(-10_000, 10_000, (37, 14)), r.integers(0, 2, 37).astype(np.uint8)
    raw = codec.pack(r.normal(size=(4, 14)), np.arange(4.0), cluster, label, values)
    got = codec.unpack(raw, 14)
    for a, b in zip(got.rows(), (cluster, label, values)):
        assert (a == b).all()
    assert (np.diff(got.block_offsets) == -(-np.bincount(cluster, minlength=4) // 8)).all()
    for wrong in (b"XXXX" + raw[4:], raw[:-1], raw + b"\0", raw[:10]):
        with pytest.raises(codec.IndexFormatError):
            codec.unpack(wrong, 14)
    with pytest.raises(codec.IndexFormatError):
        codec.unpack(raw, 13)
    codec.publish(raw, str(tmp_path / "i.bin"))
    assert (tmp_path / "i.bin").read_bytes() == raw and len(list(tmp_path.iterdir())) == 1
    empty = codec.unpack(codec.pack(np.zeros((0, 14)), np.zeros(0), np.zeros(0, int), np.zeros(0, np.uint8), np.zeros((0, 14))), 14)
    assert empty.n == 0


def test_read_requests(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([request(), request(id="r8", merchant=None), request(id="r9", more=1)]))
    got = {r.id: r.error for r in readers.read_requests(spark, str(tmp_path / "q.json")).collect()}
    assert got == {"r7": None, "r8": "missing or mistyped field", "r9": None}


def test_publish_replaces_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/deep/i.bin"
    for raw in (b"old", b"newer"):
        codec.publish_to(spark, raw, path)
        assert [(p.name, p.read_bytes()) for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")] == [("i.bin", raw)]


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from vectorvote.storage import scratch

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch(session, "x")
