import json

import pytest
import yaml
from model_files import CONFIG, model, tokenizer

from sparkloom import cli


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("cli")
    model(f / "m.gguf")
    (f / "configs").mkdir()
    (f / "configs/toy.yaml").write_text(yaml.safe_dump(CONFIG, sort_keys=False))
    tokenizer(f / "tok")
    return f


def test_round_trip_and_exit_codes(spark, folder, capsys):
    base = ["--configs", str(folder / "configs")]
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("list-ops") == 0 and "reorder_grouped_heads (permute)" in capsys.readouterr().out
    assert run("list-configs", *base) == 0 and run("validate-config", "toy", *base) == 0 and run("inspect", folder / "m.gguf") == 0
    assert "Q8_0" in capsys.readouterr().out
    assert run("convert", folder / "m.gguf", folder / "o", "--dry-run", *base) == 0 and not (folder / "o").exists()
    assert run("convert", folder / "m.gguf", folder / "o", "--bits", "4", "--tokenizer-source", folder / "tok", "--report", folder / "r.json", *base) == 0
    assert json.loads((folder / "r.json").read_text())["bits"]["target_bits"] == 4 and (folder / "o/tokenizer.json").exists()
    assert run("verify", folder / "m.gguf", folder / "o", *base) == 0
    assert run("verify", folder / "m.gguf", folder / "o", "--tolerance", "1e-9", *base) == 1
    assert run("verify", folder / "m.gguf", folder / "o", "--bits", "8", *base) == 2
    assert run("convert", folder / "m.gguf", folder / "o", *base) == 2 and run("validate-config", "none", *base) == 2
    (folder / "p.json").write_text(json.dumps({"name": "p", "default": {"bits": 3}, "rules": [{"match": "embed", "bits": 6}]}))
    assert run("convert", folder / "m.gguf", folder / "p", "--quant-profile", folder / "p.json", *base) == 0
    settings = json.loads((folder / "p/config.json").read_text())["quantization"]
    assert settings["bits"] == 3 and settings["model.embed"] == {"bits": 6, "group_size": 32}
    assert run("verify", folder / "m.gguf", folder / "p", *base) == 1  # without the profile, the rule's own bits differ from the record
    assert run("convert", folder / "m.gguf", folder / "q", "--bits", "4", "--quant-profile", folder / "p.json", *base) == 2
    with pytest.raises(SystemExit):
        run("convert", folder / "m.gguf", folder / "q", "--bits", "5")
