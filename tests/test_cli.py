"""The command line over small sizes."""

import json

import pytest

from nearfield import cli


def test_lists_evaluations(capsys):
    cli.main(["evaluate", "list"])
    assert capsys.readouterr().out.split() == ["prediction", "optimization", "scaling"]
    with pytest.raises(SystemExit):
        cli.main(["qa", "no-such-check"])


def test_probes(spark, capsys, monkeypatch):
    monkeypatch.setitem(cli.COMMANDS["qa"], "y-bounds", lambda: cli.y_bounds(60))
    cli.main(["qa", "y-bounds"])
    found = json.loads(capsys.readouterr().out)["y-bounds"]
    assert found["outside"] == 0 and 0 < found["rmse"] < 2
    assert cli.stress_proposal(30)["ask_seconds"] > 0
    assert cli.stress_model(200, 3, 10, 4)["bytes"] > 0
