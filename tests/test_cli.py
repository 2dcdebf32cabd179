"""The command line's three commands on a folder of files."""

import zipfile

import pytest

from pagewright import __main__ as cli
from pagewright.plans.catalogue import template_bytes
from pagewright.sources import docx
from tests.test_engine import REPORT


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t_14_1.rtf").write_text(REPORT)
    (tmp_path / "word.docx").write_bytes(template_bytes(["T_14_1", "OTHER"]))
    (tmp_path / "map.csv").write_text("Bookmark,Table,Parameters\nT_14_1,t_14_1.rtf,ALT\nOTHER,gone.rtf,\n")
    return tmp_path


def test_generate(spark, folder, capsys):
    cli.generate(spark, str(folder / "word.docx"), str(folder / "in"), str(folder / "map.csv"), str(folder / "out"))
    said = capsys.readouterr().out
    assert "Found 1 RTF files." in said and "1/2 Injecting T_14_1…" in said and "2/2 Injecting OTHER…" in said and "rtf_unreadable" in said
    with zipfile.ZipFile(folder / "out" / "word.docx") as z:
        assert z.read(docx.DOCUMENT).count(b"<w:tbl>") == 1
    log = "".join(p.read_text() for p in (folder / "out" / "log").glob("part-*"))
    assert "Parameters: ALT" in log and "Status    : ERROR - Cannot read RTF file 'gone'. file not found in RTF folder" in log
    with pytest.raises(SystemExit):
        cli.generate(spark, str(folder / "word.docx"), str(folder / "nowhere"), str(folder / "map.csv"), str(folder / "out2"))
    assert "Folder not found" in capsys.readouterr().out


def test_preview_and_match(spark, folder, capsys):
    cli.preview(spark, str(folder / "in"), "t_14_1")
    assert "<table" in capsys.readouterr().out
    cli.suggest(spark, str(folder / "word.docx"), str(folder / "in"))
    said = capsys.readouterr().out
    assert "T_14_1" in said and "t_14_1" in said


def test_arguments(monkeypatch):
    seen = []
    monkeypatch.setattr("sys.argv", ["pagewright", "match", "a.docx", "in/"])
    monkeypatch.setattr(cli, "suggest", lambda spark, **k: seen.append(k))
    monkeypatch.setattr(cli.SparkSession, "builder", type("B", (), {"appName": staticmethod(lambda n: type("S", (), {"getOrCreate": staticmethod(lambda: None)}))}))
    cli.main()
    assert seen == [{"template": "a.docx", "reports": "in/"}]
