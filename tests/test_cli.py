"""The command line on small files."""

import json

from corpusloom import cli


def test_help_and_version(capsys):
    assert cli.main([]) == 0 and "search" in capsys.readouterr().out
    cli.main(["version"])
    assert capsys.readouterr().out.strip() == cli.VERSION


def test_embed_search_info_convert_merge(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    rows = [{"id": str(i), "text": t, "source": s, "date": "2024-01-01"} for i, (t, s) in enumerate([("rust ownership rules", "a"), ("python pasta recipe", "b"), ("pasta carbonara", "a")])]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    cli.main(["embed", str(tmp_path / "in.jsonl"), "-o", str(tmp_path / "idx")], spark)
    assert json.loads(capsys.readouterr().out)["total_entries"] == 3
    cli.main(["search", str(tmp_path / "idx"), "pasta recipe", "--json", "-k", "2"], spark)
    assert [r["id"] for r in json.loads(capsys.readouterr().out)] == ["1", "2"]
    cli.main(["search", str(tmp_path / "idx"), "rust", "--hybrid", "-s", "a"], spark)
    assert capsys.readouterr().out.startswith("1. [A] 0")
    cli.main(["info", str(tmp_path / "idx")], spark)
    assert "a: 2" in capsys.readouterr().out
    cli.main(["convert", str(tmp_path / "idx"), str(tmp_path / "idx.json")], spark)
    capsys.readouterr()
    cli.main(["merge", str(tmp_path / "idx.json"), str(tmp_path / "idx"), "-o", str(tmp_path / "m")], spark)
    assert json.loads(capsys.readouterr().out)["total_entries"] == 3
