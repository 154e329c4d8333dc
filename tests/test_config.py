import pytest

from verdigris.plans import config as C


def test_layers(tmp_path):
    one, two = tmp_path / "a.toml", tmp_path / "b.toml"
    one.write_text('reports_dir = "old"\n[payload]\nredact = false\n')
    two.write_text('enabled_scanners = ["ruff"]\n[payload]\nmax_bytes_global = 5\n')
    got = C.load(one, two, tmp_path / "none.toml", overrides={"state_root": "s", "report_root": None})
    assert (got["report_root"], got["state_root"], got["enabled_scanners"]) == ("old", "s", ["ruff"])
    assert got["payload"] == {"max_bytes_per_finding": 16_384, "max_bytes_global": 5, "redact": False}
    assert C.DEFAULTS["payload"]["redact"] is True


@pytest.mark.parametrize("bad", [{"colour": 1}, {"payload": {"x": 1}}, {"enabled_scanners": ["nope"]}, {"enabled_scanners": ["ruff"], "disabled_scanners": ["ruff"]}])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        C.load(overrides=bad)


def test_gate_and_policy():
    limits = C.load()
    assert C.history_gate(6000, 5000, limits)["reason"] == "commit_limit_exceeded"
    assert C.history_gate(10, 5000, limits)["reason"] == "size_limit_exceeded"
    assert C.history_gate(10, 5, limits)["allowed"] and C.history_gate(9999, 9999, limits, force=True)["allowed"]
    assert C.history_gate(None, None, limits) == {"allowed": True, "reason": "within_limits"}
    assert C.history_gate(None, 1000.9, limits)["allowed"]  # whole megabytes count
    assert len(C.framework_policy([])) == 4 and C.framework_policy(["django"]) == []
