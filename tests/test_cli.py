import json

import pytest

from reuselens import cli
from reuselens.functions import model
from reuselens.sources import registry, reports, segments

S1 = 1_000_000


@pytest.fixture
def traces(tmp_path):
    hot = [(k, t * S1 // 2 + k, 1024, t > 0) for k in range(10) for t in range(120)]
    cold = [(100 + k, t * 4 * S1 + 1000 * k, 1024, t > 0) for k in range(80) for t in range(15)]
    rows = sorted(hot + cold, key=lambda r: r[1])
    folder = tmp_path / "traces"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.trace").write_bytes(segments.frame(segments.encode_batch("n", k, rows[k * 1200 : (k + 1) * 1200])))
    return folder


def test_commands(spark, traces, tmp_path, capsys):
    assert cli.main(["boundary", "--traces", str(traces)], spark) == 0
    assert capsys.readouterr().out.startswith("p50\t")
    assert cli.main(["train", "--traces", str(traces), "--boundary", "1s", "--out", str(tmp_path / "m"), "--publish", str(tmp_path / "r")], spark) == 0
    version, summary = capsys.readouterr().out.splitlines()
    meta, body = registry.Registry(str(tmp_path / "r")).get()
    assert meta["version"] == version and model.parse(body.decode()).features == 14 and json.loads(summary)["features"] == 14
    assert cli.main(["simulate", "--traces", str(traces), "--policy", "lru", "--capacity", "20kb", "--json"], spark) == 0
    run = json.loads(capsys.readouterr().out)
    assert run["object_hit"] <= run["optimum"] <= 1
    assert cli.main(["train", "--traces", str(traces), "--boundary", "1500ms"], spark) == 2
    assert cli.main(["boundary", "--traces", str(tmp_path / "none")], spark) == 1


def test_reports(spark, tmp_path):
    at = str(tmp_path / "runs.jsonl")
    reports.begin(at)
    for policy, hit in (("lru", 0.5), ("lrb", 0.6)):
        reports.append(at, {"policy": policy, "requested": policy, "model_version": "v1", "origin_latency_ns": 1000, "object_hit": hit, "client_hit": hit, "marginal_ns": 1e6, "evict_ns": 100.0 if policy == "lru" else 300.0, "evictions_per_request": 0.1, "p99_us": 5})
    with pytest.raises(FileExistsError):
        reports.begin(at)
    assert cli.main(["summarize", at], spark) == 0
    reports.append(at, {"policy": "mixed", "requested": "lru"})
    assert cli.main(["summarize", at], spark) == 1
    assert "gap to optimum" in reports.as_text({"object_hit": 0.5, "optimum": 0.61234, "bytes_used": 2048}) and reports.human(2048) == "2.0 KiB"
    assert reports.round4(0.00005) == 0.0001 and reports.round4(-0.12345) == -0.1235
